"""Scalar functions on columns, all on the JVM, and the same as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..lang.registry import LANGUAGES, all_extensions, naming, own_languages


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_id(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(_col(c), r"[^\p{IsAlphabetic}\p{N}_]", "_"))


def escape_text(c: str | Column) -> Column:
    """Backslash first, then quote, line feed, carriage return and tab."""
    c = _col(c)
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def module_name(path: str | Column, language: str) -> Column:
    separator, suffixes = naming(language)
    c = _col(path)
    for suffix in suffixes:
        c = F.regexp_replace(c, "(" + suffix.replace(".", "\\.") + r")+\z", "")
    return F.replace(F.replace(c, F.lit("/"), F.lit(separator)), F.lit("\\"), F.lit(separator))


def module_id(path: str | Column, language: str) -> Column:
    return normalize_id(module_name(path, language))


def function_id(name: str | Column, arity: str | Column, prefix: str | Column | None = None) -> Column:
    parts = [_col(name), _col(arity).cast("string")]
    return normalize_id(F.concat_ws("_", *([_col(prefix)] if prefix is not None else []), *parts))


def clean_param(c: str | Column) -> Column:
    collapsed = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    trimmed = F.regexp_replace(collapsed, r"^[,()]+|[,()]+\z", "")
    return F.when(F.octet_length(trimmed) > 80, F.substring(trimmed, 1, 80)).otherwise(trimmed)


def sanitize_callee(c: str | Column) -> Column:
    c = _col(c)
    head = F.regexp_replace(F.substring_index(c, "(", 1), "[\n\r\t ]", "")
    return F.when(~F.contains(c, F.lit("\n")) & ~F.contains(c, F.lit("(")), F.trim(c)).otherwise(F.substring_index(head, ".", -1))


def callee_base(c: str | Column) -> Column:
    """What follows the last dot or colon."""
    return F.regexp_extract(_col(c), r"([^.:]+)\z", 1)


def checksum(c: str | Column) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def lines_of_code(c: str | Column) -> Column:
    """Lines, without an empty one after a last line feed."""
    c = _col(c)
    feeds = F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    return (feeds + F.when((c != "") & ~F.endswith(c, F.lit("\n")), 1).otherwise(0)).cast("long")


def extension(path: str | Column) -> Column:
    """What follows the last dot of a file's name, if something stands before that dot."""
    ext = F.regexp_extract(_col(path), r"[^/]\.([^./]*)\z", 1)
    return F.when(ext != "", ext)


def language(path: str | Column) -> Column:
    """By the extension, upper and lower case told apart; null if unknown."""
    pairs = [F.lit(x) for pair in all_extensions().items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension(path))


def visibility(name: str | Column, of: str) -> Column:
    """By naming rules of the languages that have them; others are public."""
    name = _col(name)
    if of == "python":
        dunder = F.startswith(name, F.lit("__"))
        return (
            F.when(dunder & F.endswith(name, F.lit("__")), "public").when(dunder, "private").when(F.startswith(name, F.lit("_")), "protected").otherwise("public")
        )
    if of == "go":
        return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")
    return F.lit("public")


def diff_mode(spec: str | Column) -> Column:
    """struct(mode, base, head): nothing is `staged`, a..b and a...b are `range`, all else is `commit`."""
    spec = _col(spec)

    def cut(mark: str) -> Column:
        at = F.locate(mark, spec)
        return F.struct(F.lit("range").alias("mode"), F.substring(spec, F.lit(1), at - 1).alias("base"), F.substr(spec, at + len(mark)).alias("head"))

    none = F.lit(None).cast("string")
    plain = F.struct(F.lit("commit").alias("mode"), none.alias("base"), spec.alias("head"))
    staged = F.struct(F.lit("staged").alias("mode"), none.alias("base"), none.alias("head"))
    return F.when(spec.isNull(), staged).when(F.contains(spec, F.lit("...")), cut("...")).when(F.contains(spec, F.lit("..")), cut("..")).otherwise(plain)


def loc(code: str | Column) -> Column:
    """Lines of a text; the last one counts without a line feed too."""
    code = F.col(code) if isinstance(code, str) else code
    feeds = F.char_length(code) - F.char_length(F.replace(code, F.lit("\n"), F.lit("")))
    return (feeds + F.when((code != "") & ~F.endswith(code, F.lit("\n")), 1).otherwise(0)).cast("long")


def repo_id(url: str | Column) -> Column:
    """owner/repo of a remote's URL (git@host:path, http, https, ssh); null if there is none."""
    url = _col(url)
    path = (
        F.when(F.startswith(url, F.lit("git@")) & F.contains(url, F.lit(":")), F.regexp_extract(url, r"^[^:]*:(.*)\z", 1))
        .when(url.rlike(r"^(https?|ssh)://[^/]*/"), F.regexp_extract(url, r"^[a-z]+://[^/]*/(.*)\z", 1))
        .otherwise(F.lit(""))
    )
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^/+|/+\z", ""), r"(\.git)+\z", ""), r"^/+|/+\z", "")
    return F.when(cleaned != "", cleaned)


def unwrap_result(v: str | Column) -> Column:
    """A variant's field `text` as a variant where it is JSON, else the variant itself."""
    v = _col(v)
    return F.coalesce(F.try_parse_json(F.try_variant_get(v, "$.text", "string")), v)


def import_names(text: str | Column, language: str) -> Column:
    """The names in the text of an import statement, as an array; empty where there are none, or for other languages."""
    text = _col(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    if language == "python":
        first = F.array(F.coalesce(F.get(words, 1), F.lit("")))
        return F.when(F.startswith(text, F.lit("import ")), first).when(F.startswith(text, F.lit("from ")) & (F.size(words) >= 2), first).otherwise(none)
    if language == "rust":
        name = F.replace(F.rtrim(F.get(words, 1), F.lit(";")), F.lit("::"), F.lit("."))
        return F.when(F.startswith(text, F.lit("use ")) & (F.size(words) >= 2), F.array(name)).otherwise(none)
    if language == "go":
        return F.transform(F.filter(F.split(text, r"\r?\n"), lambda line: line.rlike('"[^"]*"')), lambda line: F.regexp_extract(line, '"([^"]*)"', 1))
    pattern = {"javascript": r"""from[^"']*["']([^"']*)["']""", "typescript": r"""from[^"']*["']([^"']*)["']""", "ruby": r"""["']([^"']*)["']"""}.get(language)
    return F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 1))).otherwise(none) if pattern else none


def _text(value: str) -> str:
    """A literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ID = r"lower(regexp_replace({}, '[^\\p{{IsAlphabetic}}\\p{{N}}_]', '_'))"


def _named(language: str) -> str:
    separator, suffixes = naming(language)
    name = "path"
    for suffix in suffixes:
        name = f"regexp_replace({name}, {_text('(' + suffix.replace('.', chr(92) + '.') + ')+' + chr(92) + 'z')}, '')"
    return f"replace(replace({name}, '/', {_text(separator)}), {_text(chr(92))}, {_text(separator)})"


def sql_functions() -> list[tuple[str, str, str, str]]:
    """Temporary SQL functions: name, parameters, result, body. Languages that users have added are in them."""
    languages = [*LANGUAGES, *own_languages()]
    module = "CASE language " + " ".join(f"WHEN {_text(x)} THEN {_named(x)}" for x in languages) + " END"
    extension = r"nullif(regexp_extract(path, '[^/]\\.([^./]*)\\z', 1), '')"
    known = ", ".join(f"{_text(e)}, {_text(x)}" for e, x in all_extensions().items())
    trimmed = r"regexp_replace(trim(regexp_replace(s, '\\s+', ' ')), '^[,()]+|[,()]+\\z', '')"
    head = r"regexp_replace(substring_index(s, '(', 1), '[\n\r\t ]', '')"
    words = r"filter(split(s, '\\s+'), w -> w <> '')"
    quoted = """regexp_extract(s, '{}', 1)"""
    js, ruby = r"""from[^"\\']*["\\']([^"\\']*)["\\']""", r"""["\\']([^"\\']*)["\\']"""
    # the quotes of these patterns are written as \x27, so that they need no escape in a literal
    js, ruby = (x.replace("\\'", r"\\x27") for x in (js, ruby))
    imports = f"""CASE
      WHEN language = 'python' AND startswith(s, 'import ') OR language = 'python' AND startswith(s, 'from ') AND size({words}) >= 2 THEN array(coalesce(get({words}, 1), ''))
      WHEN language = 'rust' AND startswith(s, 'use ') AND size({words}) >= 2 THEN array(replace(rtrim(';', get({words}, 1)), '::', '.'))
      WHEN language = 'go' THEN transform(filter(split(s, '\\\\r?\\\\n'), l -> l rlike '"[^"]*"'), l -> regexp_extract(l, '"([^"]*)"', 1))
      WHEN language IN ('javascript', 'typescript') AND s rlike '{js}' THEN array({quoted.format(js)})
      WHEN language = 'ruby' AND s rlike '{ruby}' THEN array({quoted.format(ruby)})
      ELSE cast(array() AS ARRAY<STRING>) END"""
    cut = "struct('range' AS mode, substring(spec, 1, locate('{0}', spec) - 1) AS base, substring(spec, locate('{0}', spec) + {1}) AS head)"
    remote = r"""CASE WHEN startswith(url, 'git@') AND contains(url, ':') THEN regexp_extract(url, '^[^:]*:(.*)\\z', 1)
      WHEN url rlike '^(https?|ssh)://[^/]*/' THEN regexp_extract(url, '^[a-z]+://[^/]*/(.*)\\z', 1) ELSE '' END"""
    for pattern in (r"^/+|/+\\z", r"(\\.git)+\\z", r"^/+|/+\\z"):
        remote = f"regexp_replace({remote}, '{pattern}', '')"
    return [
        ("fl_normalize_id", "s STRING", "STRING", _ID.format("s")),
        ("fl_escape", "s STRING", "STRING", r"replace(replace(replace(replace(replace(s, '\\', '\\\\'), chr(39), '\\' || chr(39)), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"),
        ("fl_module_name", "path STRING, language STRING", "STRING", module),
        ("fl_module_id", "path STRING, language STRING", "STRING", _ID.format(module)),
        ("fl_function_id", "name STRING, arity BIGINT, prefix STRING DEFAULT NULL", "STRING", _ID.format("concat_ws('_', prefix, name, cast(arity AS STRING))")),
        ("fl_visibility", "name STRING, language STRING", "STRING", r"""CASE WHEN language = 'python' AND startswith(name, '__') AND NOT endswith(name, '__') THEN 'private'
          WHEN language = 'python' AND startswith(name, '_') AND NOT (startswith(name, '__') AND endswith(name, '__')) THEN 'protected' WHEN language = 'go' AND NOT name rlike '^\\p{Lu}' THEN 'private' ELSE 'public' END"""),
        ("fl_clean_param", "s STRING", "STRING", f"CASE WHEN octet_length({trimmed}) > 80 THEN substring({trimmed}, 1, 80) ELSE {trimmed} END"),
        ("fl_sanitize_callee", "s STRING", "STRING", f"CASE WHEN NOT contains(s, chr(10)) AND NOT contains(s, '(') THEN trim(s) ELSE substring_index({head}, '.', -1) END"),
        ("fl_callee_base", "s STRING", "STRING", r"regexp_extract(s, '([^.:]+)\\z', 1)"),
        ("fl_import_names", "s STRING, language STRING", "ARRAY<STRING>", imports),
        ("fl_language", "path STRING", "STRING", f"element_at(map({known}), {extension})"),
        ("fl_diff_mode", "spec STRING", "STRUCT<mode: STRING, base: STRING, head: STRING>", f"""CASE WHEN spec IS NULL THEN struct('staged' AS mode, cast(NULL AS STRING) AS base, cast(NULL AS STRING) AS head)
          WHEN contains(spec, '...') THEN {cut.format('...', 3)} WHEN contains(spec, '..') THEN {cut.format('..', 2)} ELSE struct('commit' AS mode, cast(NULL AS STRING) AS base, spec AS head) END"""),
        ("fl_repo_id", "url STRING", "STRING", f"nullif({remote}, '')"),
        ("fl_checksum", "s STRING", "STRING", "sha2(cast(s AS BINARY), 256)"),
        ("fl_loc", "s STRING", "BIGINT", r"cast(char_length(s) - char_length(replace(s, '\n', '')) + CASE WHEN s <> '' AND NOT endswith(s, '\n') THEN 1 ELSE 0 END AS BIGINT)"),
    ]


def register_functions(spark: SparkSession) -> None:
    """Again after a language has been added, which the functions take along."""
    for name, parameters, result, body in sql_functions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
