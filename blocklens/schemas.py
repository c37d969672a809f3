"""Schemas of the tables that operators pass on (DDL)."""

PAYLOADS = "src string, entry_idx long, name string, payload binary"
ENTRIES = (
    "archive string, entry_idx long, name string, is_directory boolean, unix_mode int, mtime timestamp, method string, block_size long, "
    "uncompressed_size long, compressed_size long, crc32 long, block_lengths array<long>, data_offset long, name_is_utf8 boolean"
)
BLOCKS = "archive string, entry_idx long, block_idx int, raw_len long, comp_off long, comp_len long, data binary, crc32 long, entropy double, level int, disposition string"
SAMPLES = "entropy double, original_bytes long, stored_bytes long, disposition string"
SKIPS = "rel string, reason string, bytes long, items long"
STAGES = "stage string, seconds double"
WALK = "entry_idx long, path string, name string, is_directory boolean, size long, mtime timestamp, unix_mode int"
PROGRESS = "phase string, processed long, total long, bytesPerSecond double, etaSeconds double, done boolean"

#: Literal buckets in their declared order, which also breaks ties.
BUCKETS = ["noLiterals", "rawLiterals", "rleLiterals", "compressed1Stream", "compressed4Stream", "treeless"]
