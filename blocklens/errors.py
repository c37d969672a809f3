"""Typed errors of archive and codec operators."""


class BlocklensError(Exception):
    """Base of all errors of this library."""


class FormatError(BlocklensError):
    """An archive or frame does not follow its format."""


class UnsupportedError(BlocklensError):
    """Well formed, but outside of what is handled."""


class CodecError(BlocklensError):
    """A codec refused its input."""


class IntegrityError(BlocklensError):
    """Length or checksum differ from what is recorded."""


class MissingEntriesError(BlocklensError):
    """Entry names that were asked for are not in the archive."""


class DiskSpaceError(BlocklensError):
    """The target has too little free space."""
