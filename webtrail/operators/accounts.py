"""Accounts of a database export: who may sign in, who is an administrator, and what
stands out about whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import indicators as ind, times
from webtrail.functions.text import computed_once
from webtrail.operators.dumps import cms_of, suffix


def _names(columns: Column) -> Column:
    return F.transform(columns, lambda c: F.lower(F.trim(F.replace(c, F.lit("`"), F.lit("")))))


def _ending(candidates, from_start: bool) -> str:
    return ("(^|_)(" if from_start else "_(") + "|".join(candidates) + ")$"


def is_user_table(table: Column, columns: Column) -> Column:
    """By its name, or by columns that hold a login, an e-mail and a password: two of
    the three would be half of a shop's tables."""
    low = F.lower(F.replace(table, F.lit("`"), F.lit("")))
    named = suffix(table).isin(*fixed.USER_TABLE_NAMES) | low.rlike("(" + "|".join(fixed.USER_TABLE_NAMES) + ")$")
    def has(candidates):
        pattern = _ending(candidates, True)
        return F.exists(_names(columns), lambda c: c.rlike(pattern))

    shaped = has(fixed.LOGIN_COLUMNS) & has(fixed.EMAIL_COLUMNS) & has(fixed.PASSWORD_COLUMNS)
    return named | F.coalesce(shaped, F.lit(False))


def column_place(names: Column, candidates) -> Column:
    """Where such a column sits (from 1), 0 if nowhere: an exact name before a suffix.
    ``names`` are lower-case column names."""
    exact = F.array_position(F.transform(names, lambda c: c.isin(*candidates)), F.lit(True))
    ending = F.array_position(F.transform(names, lambda c: c.rlike(_ending(candidates, False))), F.lit(True))
    return F.when(exact > 0, exact).otherwise(ending)


# What is looked for by name, and under which column the place is kept.
_PLACES = {"id": fixed.ID_COLUMNS, "login": fixed.LOGIN_COLUMNS, "email": fixed.EMAIL_COLUMNS,
           "pass": fixed.PASSWORD_COLUMNS, "reg": fixed.REGISTERED_COLUMNS, "last": fixed.LAST_LOGIN_COLUMNS,
           "block": fixed.BLOCKED_COLUMNS}


def with_places(people: DataFrame) -> DataFrame:
    """Rows with their lower-case column names and the place of everything that is read
    by name, computed once per row."""
    named = people.withColumn("names", _names(F.col("columns")))
    return computed_once(named.withColumns({f"p_{k}": column_place(F.col("names"), c) for k, c in _PLACES.items()}))


def _at(values: Column, place: Column) -> Column:
    return F.when(place.between(1, F.size(values)), F.get(values, (place - 1).cast("int")))


def _pos(i: int) -> Column:
    return F.get("values", F.lit(i))


def clean_stamp(value: Column) -> Column:
    """"Never" in its many spellings becomes empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text.isin(*fixed.NEVER_STAMPS), "").otherwise(text)


def stamp_or_blank(value: Column) -> Column:
    """A guessed column is a date only if its value reads as one."""
    text = clean_stamp(value)
    return F.when(text.rlike(fixed.STAMP_SHAPE), text).otherwise("")


def flag(value: Column) -> Column:
    return F.coalesce((F.trim(value).try_cast("int") != 0).cast("int"), F.lit(0))


def _is_email(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(fixed.EMAIL_SHAPE), F.lit(False))


def _is_stamp(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(fixed.STAMP_SHAPE), F.lit(False))


def _account(uid, login, email, registered, password, last, blocked, admin) -> Column:
    return F.struct(
        uid.alias("user_id"), F.when(F.coalesce(login, F.lit("")) == "", "?").otherwise(login).alias("login"),
        F.when(F.coalesce(email, F.lit("")) == "", "-").otherwise(email).alias("email"),
        F.when(registered == "", "-").otherwise(registered).alias("registered"),
        ind.password_scheme(password).alias("hash_type"), last.alias("last_login"), blocked.alias("blocked"),
        admin.alias("admin"))


def _user_id() -> Column:
    return F.coalesce(F.trim(_pos(0)), F.lit("?"))


def looks_wordpress() -> Column:
    return (F.size("values") >= 7) & _is_email(_pos(4)) & _is_stamp(_pos(6))


def _first(test) -> Column:
    return F.get(F.filter("values", test), F.lit(0))


def unplaced() -> Column:
    """A row of a known CMS whose layout fits no version: the values decide."""
    return F.when(F.size("values") >= 4, _account(
        _user_id(), _pos(1), _first(_is_email), clean_stamp(_first(_is_stamp)),
        _first(lambda v: F.coalesce(v.startswith("$"), F.lit(False))), F.lit(""), F.lit(0), F.lit(False)))


def wordpress_account() -> Column:
    """Fixed layout: 1 login, 2 password, 4 e-mail, 6 registered, 8 status."""
    blocked = F.when(F.size("values") > 8, flag(_pos(8))).otherwise(0)
    fixed_layout = _account(_user_id(), _pos(1), _pos(4), clean_stamp(_pos(6)), _pos(2), F.lit(""), blocked, F.lit(False))
    return F.when(looks_wordpress(), fixed_layout).otherwise(unplaced())


def joomla_account() -> Column:
    """By column name where the dump gives names, by position where it does not."""
    def named(name, other):
        place = F.array_position("names", name)
        return F.when(place.between(1, F.size("values")), F.get("values", (place - 1).cast("int"))).otherwise(other)

    none = F.lit(None).cast("string")
    known = F.size("columns") > 0
    nine = F.size("values") >= 9
    registered = F.when(known, named("registerdate", none)).when(nine, _pos(7)).otherwise(_first(_is_stamp))
    last = F.when(known, clean_stamp(named("lastvisitdate", none))).when(nine, clean_stamp(_pos(8))).otherwise("")
    blocked = F.when(known, flag(named("block", none))).when(nine, flag(_pos(5))).otherwise(0)
    legacy = (F.coalesce(F.trim(named("gid", none)).isin(*fixed.JOOMLA_ADMIN_GROUPS), F.lit(False))
              | F.coalesce(F.lower(F.trim(named("usertype", none))).isin(*fixed.JOOMLA_ADMIN_TYPES), F.lit(False)))
    full = _account(_user_id(), named("username", _pos(2)), named("email", _pos(3)), clean_stamp(registered),
                    named("password", _pos(4)), last, blocked, legacy)
    return F.when(F.size("values") >= 5, full).otherwise(unplaced())


def generic_account() -> Column:
    """By column name alone. What cannot be located stays empty; a column called active
    or status says the opposite of blocked."""
    v = F.col("values")

    def named(what):
        return _at(v, F.col(f"p_{what}"))

    login, email = named("login"), named("email")
    raw = F.trim(named("block"))
    number = F.when(raw == "", 0).otherwise(raw.try_cast("int"))
    inverted = F.coalesce(F.get("names", (F.col("p_block") - 1).cast("int")).rlike("(active|status)$"), F.lit(False))
    blocked = F.when(number.isNull(), 0).when(inverted, (number == 0).cast("int")).otherwise((number != 0).cast("int"))
    present = (F.coalesce(login, F.lit("")) != "") | (F.coalesce(email, F.lit("")) != "")
    row = _account(
        F.coalesce(F.trim(named("id")), F.lit("?")),
        F.when(F.coalesce(login, F.lit("")) != "", login).otherwise(email), email,
        stamp_or_blank(named("reg")), named("pass"),
        stamp_or_blank(named("last")), blocked, F.lit(False))
    return F.when((F.size(v) >= 2) & present, row)


def admin_ids(rows: DataFrame) -> DataFrame:
    """(dump, user_id) of administrators: WordPress capabilities, Joomla group 8."""
    capable = ((suffix(F.col("table")) == "usermeta") & (F.size("values") >= 4)
               & F.coalesce(_pos(2).endswith("capabilities") & _pos(3).contains('"administrator"'), F.lit(False)))
    grouped = ((suffix(F.col("table")) == "user_usergroup_map") & (F.size("values") >= 2)
               & F.coalesce(F.trim(_pos(1)) == "8", F.lit(False)))
    return rows.filter(capable | grouped).select(
        "dump", F.trim(F.when(capable, _pos(1)).otherwise(_pos(0))).alias("user_id")).distinct()


def session_signals(rows: DataFrame) -> DataFrame:
    """(dump, user_id): last login and an open session from WordPress' usermeta."""
    key = F.lower(F.trim(F.coalesce(_pos(2), F.lit(""))))
    value = F.coalesce(_pos(3), F.lit(""))
    stamp = clean_stamp(value)
    read = F.when(stamp.rlike(r"^\d+$"), F.coalesce(F.date_format(
        F.timestamp_seconds(stamp.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss"), F.lit(""))).otherwise(stamp)
    session = key.endswith("session_tokens") & (F.trim(value) != "")
    login = ~session & any_ending(key, fixed.LAST_LOGIN_META_KEYS)
    meta = rows.filter((suffix(F.col("table")) == "usermeta") & (F.size("values") >= 4))
    return meta.filter(session | login).groupBy("dump", F.trim(_pos(1)).alias("user_id")).agg(
        F.max(F.when(login, read)).alias("meta_last"), F.max(session.cast("int")).alias("sessions"))


def any_ending(column: Column, endings) -> Column:
    return column.rlike("(" + "|".join(endings) + ")$")


def accounts(rows: DataFrame) -> DataFrame:
    """Every account of every dump. ``rows``: dump, table, row_no, columns, values."""
    cms = cms_of(rows.select("dump", "table").distinct())
    wordpress_rows = rows.filter((suffix(F.col("table")) == "users") & looks_wordpress()).select("dump", "table").distinct()
    # A row per dump, and per table of one: joined by a shuffle, all rows of a dump would meet in one task.
    people = (
        rows.filter(is_user_table(F.col("table"), F.col("columns")))
        .join(F.broadcast(cms), "dump", "left")
        .join(F.broadcast(wordpress_rows.withColumn("shaped", F.lit(True))), ["dump", "table"], "left")
    )
    reader = (F.when(F.array_contains("cms", "WordPress"), "WordPress").when(F.array_contains("cms", "Joomla"), "Joomla")
              .when(F.coalesce("shaped", F.lit(False)), "WordPress").otherwise(""))
    other = F.when(F.size("cms") > 0, F.array_join("cms", ", ")).otherwise("unknown")
    placed = with_places(people.withColumns({"reader": reader, "cms": F.when(reader != "", reader).otherwise(other)}))

    account = F.when(F.col("reader") == "WordPress", wordpress_account()).when(
        F.col("reader") == "Joomla", joomla_account()).otherwise(generic_account())
    read = placed.select("dump", "table", "row_no", "cms", F.inline(F.array_compact(F.array(account))))
    return (
        read.join(admin_ids(rows).withColumn("listed", F.lit(True)), ["dump", "user_id"], "left")
        .join(session_signals(rows), ["dump", "user_id"], "left")
        .select("dump", "table", "row_no", "cms", "user_id", "login", "email", "registered", "hash_type",
                (F.col("admin") | F.coalesce("listed", F.lit(False))).alias("admin"),
                F.when(F.col("last_login") != "", F.col("last_login")).otherwise(F.coalesce("meta_last", F.lit(""))).alias("last_login"),
                "blocked", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    )


def reference_seconds(found: DataFrame, created: str | None = None) -> Column:
    """The moment ages are counted from: the export's date, else the newest account."""
    newest = found.select(F.max(times.export_seconds(F.col("registered")))).scalar()
    return F.coalesce(times.export_seconds(F.lit(created)), newest) if created else newest


def with_signals(found: DataFrame, reference: Column) -> DataFrame:
    """Named observations about an account and the weight they sort by."""
    staged = found.withColumn("reference", reference).withColumn(
        "age", F.floor((F.col("reference") - times.export_seconds(F.col("registered"))) / 86400))
    tests = {
        "admin": F.col("admin"), "young": F.col("age").between(0, fixed.YOUNG_DAYS),
        "weak_hash": F.col("hash_type").contains("weak"),
        "never": F.col("admin") & (F.col("last_login") == "") & (F.col("cms") == "Joomla"),
        "session": F.col("sessions") > 0, "blocked": F.col("blocked") > 0,
    }
    signals = F.array_compact(F.array(*[F.when(tests[n], n) for n, _ in fixed.SIGNAL_WEIGHTS]))
    rank = sum((F.when(tests[n], w).otherwise(0) for n, w in fixed.SIGNAL_WEIGHTS), F.lit(0))
    return staged.withColumns({"signals": signals, "rank": rank}).drop("reference", "age")


def account_order() -> list[Column]:
    return [F.desc("rank"), F.asc("cms"), F.lower("login").asc(), F.asc("dump"), F.asc("user_id")]


def in_box(found: DataFrame, iocs: DataFrame) -> DataFrame:
    box = iocs.filter(F.col("type").isin("user", "email")).select(F.col("value").alias("login")).distinct()
    return found.withColumn("login", F.trim("login")).join(box.withColumn("in_box", F.lit(True)), "login", "left").withColumn(
        "in_box", F.coalesce("in_box", F.lit(False)))


def flagged_tables(tables: DataFrame, arts: DataFrame) -> DataFrame:
    """Tables with what is known about them. ``tables``: dump, kind, table, rows."""
    hits = arts.filter(F.col("artifact_kind") == "table").select(
        F.col("artifact").alias("table"), F.col("findings").alias("flagged"), "worst", "triage")
    return tables.join(hits, "table", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))


def database_view(tables: DataFrame, arts: DataFrame) -> DataFrame:
    """Per dump: kind, tables, rows and how many findings lie on its tables; schema
    files are kept apart by their kind."""
    return flagged_tables(tables, arts).groupBy("dump", "kind").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.sum("flagged").alias("flagged"))


def dump_totals(dumps: DataFrame, tables: DataFrame, found: DataFrame) -> DataFrame:
    """One row of totals over all exports. ``dumps``: dump, kind."""
    row = dumps.agg(F.count_if(F.col("kind") == "export").alias("dumps"), F.count_if(F.col("kind") == "schema").alias("schema_files"))
    return row.withColumns({
        "tables": tables.select(F.count(F.lit(1))).scalar(),
        "rows": tables.select(F.coalesce(F.sum("rows"), F.lit(0))).scalar(),
        "accounts": found.select(F.count(F.lit(1))).scalar(),
        "admins": found.select(F.count_if("admin")).scalar(),
    })
