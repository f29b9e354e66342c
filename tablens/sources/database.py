"""Database tables over JDBC, with typed errors that never repeat the connection string."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..errors import (
    READ_FAILURES,
    AccessDeniedError,
    AuthenticationError,
    ConfigurationError,
    DatabaseError,
    DatabaseNotFoundError,
    DataLoadingError,
    EmptyDatasetError,
    MissingDriverError,
    NetworkError,
)

# fixed values: accepted URL schemes, their JDBC prefix and how the database is attached
_SCHEMES = {
    "postgresql": "jdbc:postgresql://{host}/{db}",
    "mysql": "jdbc:mysql://{host}/{db}",
    "mariadb": "jdbc:mariadb://{host}/{db}",
    "sqlite": "jdbc:sqlite:{db}",
    "oracle": "jdbc:oracle:thin:@//{host}/{db}",
    "mssql": "jdbc:sqlserver://{host};databaseName={db}",
    "snowflake": "jdbc:snowflake://{host}/?db={db}",
}
# fixed values: words of driver messages, by kind of failure, tested in this order
_FAILURES = (
    (("no suitable driver", "classnotfound"), MissingDriverError, "JDBC driver not found"),
    (("authentication", "password", "login failed", "access denied"), AuthenticationError, "the database rejected the credentials"),
    (("could not connect", "connection refused", "timeout", "host"), NetworkError, "the database host cannot be reached"),
    (("unknown database", "invalid catalog name"), DatabaseNotFoundError, "the database does not exist"),
    (("permission denied", "not authorized", "insufficient privilege"), AccessDeniedError, "the statement is not permitted"),
    (("relation", "table"), DataLoadingError, "the table cannot be read"),
    (("does not exist",), DatabaseNotFoundError, "the database does not exist"),
)


def jdbc_options(db_url: str, table: str | None) -> dict[str, str]:
    """Reader options for a ``scheme://user:password@host:port/database`` URL and a table."""
    parts = urlsplit(db_url)
    if db_url.startswith("jdbc:"):
        options = {"url": db_url}
    elif parts.scheme in _SCHEMES:
        host = (parts.hostname or "") + (f":{parts.port}" if parts.port else "")
        name = parts.path[1:]
        options = {"url": _SCHEMES[parts.scheme].format(host=host, db=name)}
        if parts.username:
            options["user"] = unquote(parts.username)
        if parts.password:
            options["password"] = unquote(parts.password)
    else:
        raise ConfigurationError(
            f"unsupported database scheme {parts.scheme!r}; supported: {', '.join(_SCHEMES)}"
        )
    if not table:
        raise ConfigurationError("a table name is needed with a database URL")
    return options | {"dbtable": table}


def database_error(message: str, table: str) -> DataLoadingError:
    """The error that fits a driver message; the message itself is not passed on."""
    lowered = message.lower()
    for words, kind, text in _FAILURES:
        if any(word in lowered for word in words):
            return kind(f"{text} (table {table})")
    return DatabaseError(f"reading table {table} failed")


def read_table(
    spark: SparkSession,
    db_url: str,
    table: str | None = None,
    partition_column: str | None = None,
    num_partitions: int = 64,
    fetch_size: int = 10_000,
    **extra: str,
) -> DataFrame:
    """A whole table; with a numeric or date ``partition_column``, read by parallel ranges."""
    options = jdbc_options(db_url, table) | {"fetchsize": str(fetch_size)} | extra
    try:
        reader = spark.read.format("jdbc").options(**options)
        if partition_column:
            bounds = dict(options)
            query = f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {bounds.pop('dbtable')}) b"
            row = spark.read.format("jdbc").options(**bounds, dbtable=query).load().first()
            if row["lo"] is not None:
                reader = reader.options(
                    partitionColumn=partition_column,
                    lowerBound=str(row["lo"]),
                    upperBound=str(row["hi"]),
                    numPartitions=str(num_partitions),
                )
        df = reader.load()
        if not df.columns:
            raise EmptyDatasetError(f"table {table} has no columns")
        if df.limit(1).isEmpty():
            raise EmptyDatasetError(f"table {table} has no rows")
        return df
    except READ_FAILURES as error:
        raise database_error(str(error), table) from None
