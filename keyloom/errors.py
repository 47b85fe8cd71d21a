"""Errors of the conversion, each with its code."""


class ConversionError(Exception):
    code = 20


class InvalidArgument(ConversionError):
    code = 1


class SourceError(ConversionError):
    code = 2


class SchemaMismatch(ConversionError):
    code = 3


class InvalidRule(ConversionError):
    code = 4


class SortViolation(ConversionError):
    code = 5


class StorageError(ConversionError):
    code = 10


class DiskExhausted(ConversionError):
    code = 11


class MemoryExhausted(ConversionError):
    code = 12


#: The codes by name.
CODES = {"OK": 0, "INVALID_ARGUMENT": 1, "ARROW_FILE_ERROR": 2, "SCHEMA_MISMATCH": 3, "INVALID_ROW_KEY_RULE": 4, "SORT_VIOLATION": 5, "IO_ERROR": 10, "DISK_EXHAUSTED": 11, "MEMORY_EXHAUSTED": 12, "INTERNAL_ERROR": 20}


def code_of(error: BaseException) -> int:
    return error.code if isinstance(error, ConversionError) else CODES["INTERNAL_ERROR"]
