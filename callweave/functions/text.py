"""Column expressions over lines and source text. No Python runs for any row.

Null input gives null unless said otherwise. Identifiers are ASCII: look-behinds instead of \\b, which
is Unicode-aware in Java, keep the results alike in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

#: Identifiers with letters of any script, as the classic grammar takes them.
UNICODE_IDENTIFIER = r"[\p{L}_][\p{L}\p{N}_]*"

# Fixed value: the words that a function name can't be.
KEYWORDS = (
    "if", "while", "for", "switch", "return", "sizeof", "int", "char", "void", "short", "long", "float", "double",
    "unsigned", "signed", "const", "static", "extern", "inline", "struct", "union", "enum", "typedef", "volatile",
    "register", "auto", "restrict",
)

LINE = r"\A([^\t]*)\t([^\t]*)\t([0-9]+)\t([^\r\n]*)(\r\n|\n\r|\n|\r)?\z"

CALL = rf"(?<![A-Za-z0-9_])({IDENTIFIER})\s*\("


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes, then lower case. Null stays null."""
    return F.lower(F.translate(path, "\\", "/"))


def is_line(raw: Column) -> Column:
    """Whether a line has file, symbol, digits and context, parted by tabs, and at most one line end."""
    return F.coalesce(raw.rlike(LINE), F.lit(False))


def line_field(raw: Column, n: int) -> Column:
    """Field 1 to 4 of a line that is_line accepts."""
    return F.regexp_extract(raw, LINE, n)


def infer_kind(context: Column) -> Column:
    """Kind by the first that occurs in the lower-cased text; unknown for null and empty text."""
    c = F.lower(context)
    return (
        F.when(F.contains(c, F.lit("struct ")), "struct")
        .when(F.contains(c, F.lit("typedef ")), "typedef")
        .when(F.contains(c, F.lit("enum ")), "enum")
        .when(F.contains(c, F.lit("#define ")), "macro")
        .when(F.contains(c, F.lit("(")), "function")
        .otherwise("unknown")
    )


def first_callee(context: Column) -> Column:
    """The first identifier before a parenthesis, keywords included; unknown without one or for null."""
    return F.coalesce(F.nullif(F.regexp_extract(context, CALL, 1), F.lit("")), F.lit("unknown"))


def all_callees(context: Column) -> Column:
    """Array of all identifiers before a parenthesis that aren't keywords, in order, repeats kept."""
    found = F.regexp_extract_all(context, F.lit(CALL), 1)
    return F.coalesce(F.filter(found, lambda x: ~F.lower(x).isin(*KEYWORDS)), F.array().cast("array<string>"))


# What lines that define something look like, with {0} for an identifier. The first rule that
# fits gives kind and name. Of the loose grammar, a typedef line is looked through from its beginning.
LOOSE_RULES = (
    ("macro", r"\A#define\s+({0})"),
    ("typedef", r"typedef\s+(?:struct|union|enum)\s+({0})\s*\{{"),
    ("typedef", r"({0})\s*;"),
    ("struct", r"\Astruct\s+({0})\s*\{{"),
    ("union", r"\Aunion\s+({0})\s*\{{"),
    ("enum", r"\Aenum\s+({0})\s*\{{"),
)
STRICT_RULES = (
    ("macro", r"\A\s*#define\s+({0})"),
    ("typedef", r"\A\s*typedef\s+(?:struct\s+|union\s+|enum\s+)?({0})\s*[{{;]"),
    ("struct", r"\A\s*struct\s+({0})\s*\{{"),
    ("union", r"\A\s*union\s+({0})\s*\{{"),
    ("enum", r"\A\s*enum\s+({0})\s*\{{"),
)


def _named(text: Column, rules: tuple[tuple[str, str], ...], identifier: str) -> list[tuple[Column, str]]:
    """(name or null, kind) by each rule."""
    return [(F.nullif(F.regexp_extract(text, rule.format(identifier), 1), F.lit("")), kind) for kind, rule in rules]


def _first(named: list[tuple[Column, str]]) -> Column:
    """struct(name, kind) of the first that isn't null."""
    return F.coalesce(*[F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(kind).alias("kind"))) for name, kind in named])


def symbol_in_context(context: Column) -> Column:
    """struct(name, kind) of what a line defines, null if nothing.

    Macros and typedefs first, then struct, union and enum with a brace, then the last identifier
    before a parenthesis unless it is a keyword.
    """
    c = F.regexp_replace(context, r"\A\s+|\s+\z", "")
    named = [(F.when(c.startswith("typedef"), name) if kind == "typedef" else name, kind) for name, kind in _named(c, LOOSE_RULES, IDENTIFIER)]
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"({IDENTIFIER})\s*\("), 1), F.lit(-1))
    return _first([*named, (F.when(~F.lower(last).isin(*KEYWORDS), last), "function")])


def global_definition(context: Column, identifier: str = IDENTIFIER) -> Column:
    """struct(name, kind) by the stricter grammar, which looks at the beginning only, null if nothing.

    typedef needs a name right before a brace or semicolon: typedefs of several words aren't found.
    identifier may be UNICODE_IDENTIFIER.
    """
    return _first(_named(context, STRICT_RULES, identifier))


def included_file(context: Column) -> Column:
    """The file an include line names, null for any other line."""
    return F.nullif(F.regexp_extract(context, r'\A\s*#\s*include\s*[<"]([^>"]+)[>"]', 1), F.lit(""))


def matches(symbol: Column, pattern: str) -> Column:
    """Whether the symbol holds the pattern, literally and regardless of letter case."""
    return F.contains(F.lower(symbol), F.lower(F.lit(pattern)))


def occurrences(symbol: Column, pattern: str) -> Column:
    """How often the pattern occurs in the symbol, overlaps included. An empty pattern fits everywhere."""
    p = pattern.lower()
    s = F.lower(symbol)
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - len(p) + 1, F.lit(0)))
    return F.when(F.length(s) < len(p), 0).otherwise(
        F.size(F.filter(starts, lambda i: F.substring(s, i, F.lit(len(p))) == p))
    )


def is_identifier(name: Column) -> Column:
    return name.rlike(rf"\A{IDENTIFIER}\z")


def index_line(raw: Column) -> Column:
    """struct(file, scope, line, context) of a blank-separated index line, null with fewer fields."""
    p = F.split(F.regexp_replace(raw, r"\A\s+|\s+\z", ""), " ", 4)
    return F.when(
        F.size(p) == 4,
        F.struct(normalize_path(p[0]).alias("file"), p[1].alias("scope"), p[2].alias("line"), p[3].alias("context")),
    )


def line_fields(raw: Column) -> Column:
    """struct(file, symbol, line, context) of a tab-separated line whose line number is any text, without
    its line end; null with fewer than four fields."""
    p = F.split(F.regexp_replace(raw, r"(?:\r\n|\n|\r)\z", ""), "\t", 4)
    return F.when(F.size(p) == 4, F.struct(*[p[i].alias(n) for i, n in enumerate(("file", "symbol", "line", "context"))]))


def tab_line(*fields: Column) -> Column:
    """Fields joined by tabs, as the extracted files have them."""
    return F.concat_ws("\t", *fields)


def edge_id(source: Column, target: Column) -> Column:
    return F.concat_ws("_", source, target)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)
