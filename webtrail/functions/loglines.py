"""Access-log and error-log lines to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import times, uris
from webtrail.functions.text import computed_once

SEPARATOR = "\u0001"


def _groups(line: Column, pattern: str, order: list[int]) -> Column:
    """All groups of one match as text parts, by a single evaluation of the pattern.

    The replacement writes the groups behind a separator no log writer emits raw; a
    line without a match comes back unchanged and so does not begin with it.
    """
    template = "".join(f"{SEPARATOR}${n}" if n else SEPARATOR for n in order)
    return F.regexp_replace(line, F.lit(pattern), F.lit(template))


def with_record(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``record``: the struct of an access-log line, NULL when no format fits.

    Combined format first, common format only where that fails. The steps are columns of
    their own, so each pattern runs once per line and the plan stays small.
    """
    line = F.col(value)
    clean = F.when(line.contains(SEPARATOR), F.translate(line, SEPARATOR, "�")).otherwise(line)
    part, regular = F.col("_part"), F.col("_part")[3] != ""
    record = F.struct(
        part[1].alias("ip"),
        F.col("_moment")["epoch"].alias("epoch"),
        F.col("_moment")["tz"].alias("tz"),
        F.when(regular, part[3]).otherwise("-").alias("method"),
        F.coalesce(F.when(regular, _filled(part[4])).otherwise(_filled(part[5])), F.lit("-")).alias("uri"),
        status_code(part[6]).alias("status"),
        response_size(part[7]).alias("size"),
        part[8].alias("referrer"),
        part[9].alias("agent"),
    )
    staged = (
        lines.withColumn("_line", clean)
        .withColumn("_combined", _groups(F.col("_line"), fixed.COMBINED_LINE, [1, 2, 3, 4, 5, 6, 7, 8, 9]))
        .withColumn("_found", F.when(F.col("_combined").startswith(SEPARATOR), F.col("_combined")).otherwise(
            _groups(F.col("_line"), fixed.COMMON_LINE, [1, 2, 3, 4, 0, 5, 6, 0, 0])))
        .withColumn("_part", F.when(F.col("_found").startswith(SEPARATOR), F.split("_found", SEPARATOR)))
        .withColumn("_moment", times.clf_time(F.col("_part")[2]))
        .withColumn("record", F.when(F.col("_part").isNotNull(), record))
    )
    return computed_once(staged.drop("_line", "_combined", "_found", "_part", "_moment"))


def _filled(column: Column) -> Column:
    return F.when(column != "", column)


def status_code(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def response_size(text: Column) -> Column:
    """Bytes sent; a dash is "not recorded", which is not zero."""
    return text.try_cast("bigint")


def client_address(raw: Column) -> Column:
    """Error-log client without its port."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bracketed = F.regexp_extract(text, r"^\[([0-9a-fA-F:]+)\]", 1)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    return (
        F.when(text == "", text)
        .when(bracketed != "", bracketed)
        .when(colons == 1, F.substring_index(text, ":", 1))
        .otherwise(F.substring_index(text, " ", 1))
    )


def with_error_record(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds epoch_naive, client and message of an error-log line; other lines leave."""
    part = F.col("_part")
    staged = (
        lines.withColumn("_apache", _groups(F.col(value), fixed.APACHE_ERROR_LINE, [1, 3, 4]))
        .withColumn("_found", F.when(F.col("_apache").startswith(SEPARATOR), F.col("_apache")).otherwise(
            _groups(F.col(value), fixed.NGINX_ERROR_LINE, [1, 0, 3])))
        .withColumn("_part", F.when(F.col("_found").startswith(SEPARATOR), F.split("_found", SEPARATOR)))
        .withColumn("record", F.when(part.isNotNull(), F.struct(
            times.error_log_seconds(part[1]).alias("epoch_naive"), client_address(part[2]).alias("client"),
            part[3].alias("message"))))
        .drop("_apache", "_found", "_part")
    )
    rest = [c for c in lines.columns if c != value]
    return staged.select(*rest, F.inline(F.array_compact(F.array("record"))))


def php_paths(message: Column) -> Column:
    """array<struct<path, line>> of every PHP file a message names."""
    paths = F.regexp_extract_all(message, F.lit(fixed.ERROR_PATH), F.lit(1))
    first = F.regexp_extract_all(message, F.lit(fixed.ERROR_PATH), F.lit(2))
    second = F.regexp_extract_all(message, F.lit(fixed.ERROR_PATH), F.lit(3))
    return F.transform(
        F.arrays_zip(paths.alias("p"), first.alias("a"), second.alias("b")),
        lambda x: F.struct(
            x["p"].alias("path"),
            F.coalesce(x["a"].try_cast("int"), x["b"].try_cast("int")).alias("line"),
        ),
    )


def request_columns(record: Column) -> list[Column]:
    """The request columns of a parsed line, with the leaf every file question needs."""
    names = ["ip", "epoch", "tz", "method", "uri", "status", "size", "referrer", "agent"]
    return [record[n].alias(n) for n in names] + [uris.leaf(record["uri"]).alias("leaf")]
