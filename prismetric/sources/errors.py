"""What can be wrong with an input."""


class UnsupportedFormatError(ValueError):
    """No reader for this kind of file."""


class RemoteAccessError(RuntimeError):
    """A remote input can't be reached or read."""


class SQLiteTableError(ValueError):
    """No such table in the file."""


class ExcelReaderError(ValueError):
    """Not a workbook, or no such sheet."""
