"""Errors a caller can act on. Messages never contain connection passwords."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

# what a failed read can raise, depending on where in Spark it fails
READ_FAILURES = (PySparkException, Py4JJavaError)


class TablensError(Exception):
    """Base class of every error raised by this package."""


class ConfigurationError(TablensError):
    """An option, argument or setting is missing, unknown or contradictory."""


class UnknownSourceError(ConfigurationError):
    """No reader is registered for the given path or URL."""


class DataLoadingError(TablensError):
    """The source exists but cannot be read."""


class EmptyDatasetError(TablensError):
    """The source has no columns or no rows."""


class DatabaseError(DataLoadingError):
    """A database refused or failed the read for an unclassified reason."""


class MissingDriverError(DatabaseError):
    """The JDBC driver class is not on the classpath."""


class AuthenticationError(DatabaseError):
    """The database rejected the credentials."""


class NetworkError(DatabaseError):
    """The database host cannot be reached."""


class DatabaseNotFoundError(DatabaseError):
    """The named database does not exist."""


class AccessDeniedError(DatabaseError):
    """The user may not run this statement."""
