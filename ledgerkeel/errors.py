"""Errors raised on the driver before or after a Spark job."""


class DatasetError(RuntimeError):
    """A dataset manifest, data file or target table does not fit together."""


class LedgerError(RuntimeError):
    """A ledger is not usable for the requested operation."""


class StateError(RuntimeError):
    """A live state does not fit the expected state or its history."""
