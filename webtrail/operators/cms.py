"""CMS inventory of a web root: installs, extensions, versions and what is flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import uris


def _text(content: Column, limit: int | None = None) -> Column:
    data = F.substring(content, 1, limit) if limit else content
    return F.make_valid_utf8(data.cast("string"))


def _filled(column: Column) -> Column:
    return F.when(column != "", column)


def joomla_version(text: Column) -> Column:
    def const(name):
        return F.regexp_extract(text, r"const\s+" + name + r"\s*=\s*(\d+)", 1)

    major, minor, patch = const("MAJOR_VERSION"), const("MINOR_VERSION"), const("PATCH_VERSION")
    release = F.regexp_extract(text, fixed.JOOMLA_RELEASE, 1)
    level = F.regexp_extract(text, fixed.JOOMLA_DEV_LEVEL, 1)
    return F.when((major != "") & (minor != "") & (patch != ""), F.concat_ws(".", major, minor, patch)).when(
        (release != "") & (level != ""), F.concat_ws(".", release, level))


def version_files() -> Column:
    """The path shapes a CMS keeps its version in; a filter before content is read."""
    return F.lower("path").rlike(r"/(wp-includes|libraries/src|libraries/cms/version)/version\.php$")


def installs(files: DataFrame) -> DataFrame:
    """(root, cms, version, version_source). A newer Joomla layout wins at one root."""
    low = F.lower("path")
    found = files.filter(version_files()).withColumns({
        "shape": F.when(low.endswith("/wp-includes/version.php"), "wordpress")
        .when(low.endswith("/libraries/src/version.php"), "joomla4").otherwise("joomla3"),
        "text": _text(F.col("content"))})
    root = F.regexp_replace("path", r"(?i)/(wp-includes|libraries/src|libraries/cms/version)/version\.php$", "")
    wp = F.col("shape") == "wordpress"
    version = F.when(wp, _filled(F.regexp_extract("text", fixed.WP_VERSION, 1))).otherwise(joomla_version(F.col("text")))
    rows = found.select(root.alias("root"), F.when(wp, "WordPress").otherwise("Joomla").alias("cms"),
                        F.coalesce(version, F.lit(fixed.UNKNOWN_VERSION)).alias("version"),
                        F.col("path").alias("version_source"), "shape")
    return rows.groupBy("root", "cms").agg(F.max(F.struct("shape", "version_source", "version")).alias("m")).select(
        "root", "cms", "m.version", "m.version_source")


def _in_installs(files: DataFrame, found: DataFrame, cms: str) -> DataFrame:
    """Files with their path below the install they lie in. Installs are met on the
    ancestors of a path, an equality."""
    roots = found.filter(F.col("cms") == cms).select("root")
    near = files.select("path", "content", F.explode(uris.prefixes(F.col("path"))).alias("root"))
    return near.join(roots, "root").withColumn("rel", F.substr("path", F.length("root") + 2))


def _header(text: Column, pattern: str) -> Column:
    return _filled(F.regexp_extract(text, pattern, 1))


def _pick(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the first file, in name order, that carries a header."""
    order = F.when(F.col("header").isNotNull(), F.col("path"))
    return df.groupBy(*keys).agg(F.min_by(F.struct("header", "version", "path"), order).alias("h"))


_ITEM = ("root", "type", "name", "slug", "version", "path", "version_source")


def wordpress_items(files: DataFrame, found: DataFrame) -> DataFrame:
    """Plugins, themes, and plugins that came inside a theme (under their own type)."""
    inside = _in_installs(files.filter(F.col("path").contains("/wp-content/")), found, "WordPress")
    part = F.split("rel", "/")
    depth = F.size(part)
    head = _text(F.col("content"), fixed.HEAD_BYTES)
    unknown = F.lit(fixed.UNKNOWN_VERSION)
    php = F.col("rel").endswith(".php")
    staged = inside.select("root", "path", "rel", part.alias("part"), depth.alias("depth"), head.alias("head"), php.alias("php"))
    plugin_name = F.when(F.col("php"), _header(F.col("head"), fixed.WP_PLUGIN_NAME))
    version = F.coalesce(_header(F.col("head"), fixed.WP_HEADER_VERSION), unknown)

    plugins = staged.filter(F.col("rel").startswith("wp-content/plugins/"))
    single = plugins.filter((F.col("depth") == 3) & F.col("php")).withColumn("header", plugin_name).filter("header is not null").select(
        "root", F.lit("Plugin").alias("type"), F.col("header").alias("name"),
        F.regexp_replace(F.col("part")[2], r"\.php$", "").alias("slug"), version.alias("version"), "path",
        F.col("path").alias("version_source"))
    own = plugins.filter(F.col("depth") >= 4).withColumn("slug", F.col("part")[2]).withColumn(
        "header", F.when(F.col("depth") == 4, plugin_name)).withColumn("version", version)
    dirs = _pick(own, ["root", "slug"]).select(
        "root", F.lit("Plugin").alias("type"), F.coalesce("h.header", "slug").alias("name"), "slug",
        F.coalesce("h.version", unknown).alias("version"),
        F.coalesce("h.path", F.concat("root", F.lit("/wp-content/plugins/"), "slug")).alias("path"),
        F.coalesce("h.path", F.lit("")).alias("version_source"))

    themed = staged.filter(F.col("rel").startswith("wp-content/themes/") & (F.col("depth") >= 4)).withColumn("slug", F.col("part")[2])
    style = (F.col("depth") == 4) & (F.col("part")[3] == "style.css")
    name = F.when(style, _header(F.col("head"), fixed.WP_THEME_NAME))
    number = F.when(style, _header(F.col("head"), fixed.WP_HEADER_VERSION))
    themes = themed.groupBy("root", "slug").agg(
        F.max(name).alias("n"), F.max(number).alias("v"), F.max(F.when(number.isNotNull(), F.col("path"))).alias("s")).select(
        "root", F.lit("Theme").alias("type"), F.coalesce("n", "slug").alias("name"), "slug", F.coalesce("v", unknown).alias("version"),
        F.concat("root", F.lit("/wp-content/themes/"), "slug").alias("path"), F.coalesce("s", F.lit("")).alias("version_source"))

    below = F.slice("part", F.lit(4), F.greatest(F.size("part") - 4, F.lit(0)))  # directories between theme and file
    bundled = themed.filter(F.col("php")).withColumn("dirs", below).filter(
        F.size("dirs").between(1, 2) & ~F.exists("dirs", lambda d: d.isin("node_modules", "vendor"))).withColumns({
            "theme": F.col("slug"), "dir": F.try_element_at("dirs", F.lit(-1)), "header": plugin_name, "version": version,
            "folder": F.regexp_replace("path", r"/[^/]+$", "")})
    inner = _pick(bundled, ["root", "theme", "folder", "dir"]).filter("h.header is not null").select(
        "root", F.concat(F.lit("Plugin (bundled in theme "), F.col("theme"), F.lit(")")).alias("type"),
        F.col("h.header").alias("name"), F.col("dir").alias("slug"), F.col("h.version").alias("version"),
        F.col("folder").alias("path"), F.col("h.path").alias("version_source"))
    return single.unionByName(dirs).unionByName(themes).unionByName(inner).select(*_ITEM)


# Where Joomla keeps its extensions, and what they are called there.
JOOMLA_PLACES = (
    ("administrator/components", "Component"), ("components", "Component (Site)"), ("modules", "Module"),
    ("administrator/modules", "Module (Admin)"), ("templates", "Template"),
    ("administrator/templates", "Template (Admin)"),
)


def joomla_items(files: DataFrame, found: DataFrame) -> DataFrame:
    """Components, modules, plugins and templates; a directory without a readable
    manifest stays, with an unknown version."""
    inside = _in_installs(files, found, "Joomla")
    parent, slug, rest = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for place, label in JOOMLA_PLACES:
        rx = "^" + place + r"/([^/]+)/(.+)$"
        here = F.col("rel").rlike(rx)
        kind = F.when(here, label).otherwise(kind)
        parent = F.when(here, place).otherwise(parent)
        slug = F.when(here, F.regexp_extract("rel", rx, 1)).otherwise(slug)
        rest = F.when(here, F.regexp_extract("rel", rx, 2)).otherwise(rest)
    plugin = r"^plugins/([^/]+)/([^/]+)/(.+)$"
    is_plugin = F.col("rel").rlike(plugin)
    group = F.regexp_extract("rel", plugin, 1)
    staged = inside.select(
        "root", "path", "content",
        F.when(is_plugin, F.concat(F.lit("Plugin ("), group, F.lit(")"))).otherwise(kind).alias("type"),
        F.when(is_plugin, F.concat(F.lit("plugins/"), group)).otherwise(parent).alias("parent"),
        F.when(is_plugin, F.regexp_extract("rel", plugin, 2)).otherwise(slug).alias("slug"),
        F.when(is_plugin, F.regexp_extract("rel", plugin, 3)).otherwise(rest).alias("rest"),
    ).filter("type is not null")
    template = F.col("type").startswith("Template")
    staged = staged.filter(~(template & (F.col("slug") == "system")))
    xml = _text(F.col("content"))
    direct = ~F.col("rest").contains("/") & F.when(template, F.col("rest") == "templateDetails.xml").otherwise(F.col("rest").endswith(".xml"))
    manifest = direct & xml.rlike(r"(?s)^\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(extension|install)\b")
    # The declaration and a doctype go first: an external entity is never resolved.
    body = F.when(manifest, F.regexp_replace(xml, r"(?s)<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", ""))
    read = staged.withColumns({
        "header": F.when(manifest, F.coalesce(_filled(F.trim(F.regexp_extract(body, r"(?s)<name>\s*([^<]*?)\s*</name>", 1))),
                                              F.regexp_replace(F.col("rest"), r"\.xml$", ""))),
        "version": F.when(manifest, F.coalesce(_filled(F.trim(F.regexp_extract(body, r"(?s)<version>\s*([^<]*?)\s*</version>", 1))),
                                               F.lit(fixed.UNKNOWN_VERSION)))})
    return _pick(read, ["root", "type", "parent", "slug"]).select(
        "root", "type", F.coalesce("h.header", "slug").alias("name"), "slug",
        F.coalesce("h.version", F.lit(fixed.UNKNOWN_VERSION)).alias("version"),
        F.coalesce("h.path", F.concat_ws("/", "root", "parent", "slug")).alias("path"),
        F.coalesce("h.path", F.lit("")).alias("version_source")).select(*_ITEM)


def extension_scope(path: Column, slug: Column) -> tuple[Column, Column]:
    """What an extension spans: its directory, or one file. A single file never
    inherits the folder it lies in."""
    low = F.lower(F.rtrim(uris.forward_slashes(path), F.lit("/")))
    part = F.split(low, "/")
    name, above = F.element_at(part, -1), F.try_element_at(part, F.lit(-2))
    want = F.lower(F.trim(slug))
    parent = F.array_join(F.slice(part, F.lit(1), F.size(part) - 1), "/")
    inner = (name != want) & F.coalesce(above == want, F.lit(False))
    kind = F.when((name == want) | inner, "dir").when(name.contains("."), "file").otherwise("dir")
    return kind, F.when(inner, parent).otherwise(low)


def flagged_items(items: DataFrame, arts: DataFrame, shown: int = 8) -> DataFrame:
    """Extensions with the flagged files that lie in them: the exact count and the few
    worst. Files meet extensions on their ancestors, an equality."""
    kind, scope = extension_scope(F.col("path"), F.col("slug"))
    scoped = items.withColumns({"scope_kind": kind, "scope": scope})
    keys = ["root", "type", "slug", "path"]
    files = arts.filter(F.col("artifact_kind") == "file").withColumn(
        "low", F.lower(F.rtrim(uris.forward_slashes(F.col("artifact")), F.lit("/"))))
    near = files.select("artifact", "worst", "low", F.explode(uris.prefixes(F.col("low"))).alias("scope"))
    hits = scoped.join(near, "scope").filter((F.col("scope_kind") == "dir") | (F.col("low") == F.col("scope")))
    totals = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("flagged"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("worst", "artifact"))
    listed = hits.withColumn("n", place).filter(F.col("n") <= shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("worst", "artifact"))).alias("artifacts"))
    return (
        scoped.join(totals, keys, "left").join(listed, keys, "left")
        .withColumns({"flagged": F.coalesce("flagged", F.lit(0)), "artifacts": F.coalesce(
            "artifacts", F.array().cast("array<struct<worst:int,artifact:string>>"))})
    )


def with_overrides(rows: DataFrame, key: Column, overrides: DataFrame) -> DataFrame:
    """The analyst's version laid over the measured one, which stays beside it.
    ``overrides``: key, set_version, set_note."""
    return rows.withColumn("key", key).join(overrides, "key", "left").withColumns({
        "version_parsed": F.col("version"), "version": F.coalesce("set_version", "version")})


def item_key() -> Column:
    """The identity of an extension across analyses."""
    return F.concat_ws("|", "root", "type", "slug")


def totals(found: DataFrame, items: DataFrame) -> DataFrame:
    unknown = F.count_if(F.col("version") == fixed.UNKNOWN_VERSION)
    return found.agg(F.count(F.lit(1)).alias("installs"), unknown.alias("u1")).withColumns({
        "items": items.select(F.count(F.lit(1))).scalar(), "u2": items.select(unknown).scalar(),
    }).select("installs", "items", (F.col("u1") + F.col("u2")).alias("unknown_versions"))
