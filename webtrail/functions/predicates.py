"""Detection predicates on one value, each a boolean Column.

The patterns with look-arounds are costly, so each stands behind a plain substring
test that every match must pass. The test changes no result, only how many rows
reach the regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions.text import contains_any


def _guarded(value: Column, needed: str, pattern: str) -> Column:
    text = F.coalesce(value, F.lit(""))
    return contains_any(F.lower(text), fixed.NEEDED_TEXT[needed]) & text.rlike(pattern)


def scanner_agent(agent: Column) -> Column:
    return F.coalesce(agent, F.lit("")).rlike(fixed.SCANNER_AGENT)


def login_endpoint(uri: Column) -> Column:
    return _guarded(uri, "login", fixed.LOGIN_ENDPOINT)


def joomla_authenticated(uri: Column) -> Column:
    return _guarded(uri, "joomla_admin", fixed.JOOMLA_AUTHENTICATED)


def wordpress_authenticated(uri: Column) -> Column:
    return _guarded(uri, "wordpress_admin", fixed.WORDPRESS_AUTHENTICATED)


def authenticated_area(uri: Column) -> Column:
    return joomla_authenticated(uri) | wordpress_authenticated(uri)


def sql_injection(uri: Column) -> Column:
    return _guarded(uri, "sqli", fixed.SQL_INJECTION)


def path_traversal(uri: Column) -> Column:
    return _guarded(uri, "traversal", fixed.PATH_TRAVERSAL)


def upload_php(uri: Column) -> Column:
    return _guarded(uri, "php", fixed.UPLOAD_PHP)


def cms_directory_php(uri: Column) -> Column:
    return _guarded(uri, "php", fixed.CMS_DIRECTORY_PHP)


def answered_ok(status: Column) -> Column:
    return status.between(200, 299)


# Status classes by the first digit; "err" is every answer from 400 on.
STATUS_CLASSES = {"2xx": (200, 299), "3xx": (300, 399), "4xx": (400, 499),
                  "5xx": (500, 599), "err": (400, 599)}


def status_class(status: Column, name: str) -> Column:
    low, high = STATUS_CLASSES[name]
    return status.between(low, high)


def in_upload_directory(site_path: Column) -> Column:
    return site_path.rlike(fixed.UPLOAD_SEGMENT) & ~site_path.rlike(fixed.UPLOAD_EXCLUDED)


def extension(base_name: Column) -> Column:
    """Lower-case extension with its dot, '' without one (a leading dot is no extension)."""
    stem = F.regexp_replace(F.lower(base_name), r"^\.+", "")
    return F.when(stem.contains("."), F.concat(F.lit("."), F.substring_index(stem, ".", -1))).otherwise("")


def is_php_name(base_name: Column) -> Column:
    low = F.lower(base_name)
    return extension(low).isin(*fixed.PHP_EXTENSIONS) | low.rlike(fixed.EXEC_EXTENSION_ANYWHERE)


def is_image_name(base_name: Column) -> Column:
    return extension(base_name).isin(*fixed.IMAGE_EXTENSIONS)


def double_extension(base_name: Column) -> Column:
    return F.lower(base_name).rlike(fixed.DOUBLE_EXTENSION)


def cms_guard(text: Column) -> Column:
    """A CMS bootstrap guard in the first 4096 bytes (text is bytes read as Latin-1)."""
    return F.substring(text, 1, fixed.GUARD_BYTES).rlike(fixed.CMS_GUARD)


def executable_surface(text: Column) -> Column:
    return text.rlike(fixed.EXEC_SURFACE)


def short_tag_is_source(text: Column, window: int = 48, need: float = 0.9) -> Column:
    """A ``<?=`` followed by readable text: source code, not three bytes of pixels."""
    tails = F.regexp_extract_all(text, F.lit(r"(?s)<\?=(?=(.{0,%d}))" % window), F.lit(1))
    unreadable = r"[^\x20-\x7e\t\n\r]"
    return text.contains("<?=") & F.exists(
        tails,
        lambda t: (F.length(t) > 0)
        & (F.length(F.regexp_replace(t, unreadable, "")) >= F.length(t) * F.lit(need)),
    )


def interesting_error(message: Column) -> Column:
    return message.rlike(fixed.ERROR_INTERESTING)


def hard_error(message: Column) -> Column:
    return message.rlike(fixed.ERROR_HARD)


def rule_enabled(rule_id: Column, disabled: list[str]) -> Column:
    """An id nobody switched off counts as on, also one nobody knows."""
    return ~rule_id.isin(*disabled) if disabled else F.lit(True)
