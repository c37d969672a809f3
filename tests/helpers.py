"""Generators of test bytes."""


def lcg(size: int, seed: int, state: bool = False):
    """Bytes of a fixed linear congruential generator."""
    out = bytearray()
    for _ in range(size):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(seed >> 32 & 0xFF)
    return (bytes(out), seed) if state else bytes(out)


def mixed(size: int, seed: int, fill: int = 0, run: int = 65536, noise: int = 65536) -> bytes:
    """Runs of a constant byte and runs of noise in turn."""
    out = bytearray()
    while len(out) < size:
        out += bytes([fill]) * run
        more, seed = lcg(noise, seed, state=True)
        out += more
    return bytes(out[:size])
