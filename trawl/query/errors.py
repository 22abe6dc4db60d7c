"""What can be wrong with a query."""


class QueryError(ValueError):
    pass


class UnknownProperty(QueryError):
    pass


class BadDate(QueryError):
    pass


class BadRegex(QueryError):
    pass


class UnsupportedOp(QueryError):
    def __init__(self, key: str, op: str):
        super().__init__(f"{key} does not take {op}")
        self.key, self.op = key, op


def kind_of(error: BaseException) -> str:
    """What went wrong, for whoever shows it: query, missing, version, taken, cancelled or other."""
    from trawl.catalog import CatalogDrift
    from trawl.commits import Taken

    if isinstance(error, QueryError):
        return "query"
    for kinds, name in ((FileNotFoundError, "missing"), (CatalogDrift, "version"), (Taken, "taken")):
        if isinstance(error, kinds):
            return name
    text = str(error)
    if "PATH_NOT_FOUND" in text or "FileNotFoundException" in text:
        return "missing"
    return "cancelled" if "cancelled" in text.lower() or "OPERATION_CANCELED" in text else "other"
