"""Which files of a code collection nobody wrote by hand: belief propagation over directory trees.

Every file, every family of like siblings in a directory and every directory has a hidden label
(handwritten, generated, minified, vendored, blob). Directories depend on their parent directory,
families on their directory and files on their family, each by a table of compatibilities; files show
features of their rows and names, directories of their names. The graph is a forest, so one pass up and
one pass down give exact marginals. These are the E step of a few rounds of expectation maximisation:
the probabilities of all features and compatibilities are then counted anew, from all files.

Both passes go level by level over tables; a directory or family of any size is one row whose messages
were summed before the shuffle. Only the tables of the model, whose size is fixed, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.skew import salted_join
from callweave.runtime import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
_N = len(LABELS)

# Names that tell what a directory holds.
VENDOR_DIRS = (
    "vendor", "vendored", "vendors", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "3rd-party",
    "external", "externals", "extern", "extlib", "extlibs", "deps", "bundled", "node_modules", "upstream",
)
WEAK_VENDOR_DIRS = ("contrib", "imported")
GENERATED_DIRS = ("generated", "autogen", "auto_generated", "autogenerated", "gen", "gensrc", "genfiles", "_generated")

GENERATED_NAME = r"(?:\.(?:pb|grpc\.pb|tab|gen|yy|generated)\.[a-z]+$)|(?:_(?:wrap|generated|gen)\.[a-z]+$)|(?:^(?:lex\.|moc_|qrc_|ui_))"
MINIFIED_NAME = r"[.-]min\.[a-z]+$"
VERSIONED_DIR = r"-v?\d+(?:\.\d+)+$"

# Notices count only where they open a comment: code that prints or looks for one isn't one.
GENERATED_NOTICE = (
    r"(?i)^\s*(?:/\*+|//+|#|\*)\s*<?(?:@generated\b|auto-?generated\b|(?:code |file )?generated (?:by|from|with|using|automatically)\b"
    r"|machine-(?:made|generated)\b|do not (?:edit|modify)\b|this (?:file|code|header|source) (?:was|is|has been) "
    r"(?:automatically |auto-?)?(?:generated|produced|created|written|built|made)\b|diese datei wurde .*(?:erzeugt|generiert)"
    r"|ce fichier a été généré|este archivo (?:fue|ha sido) generado|[^*]{0,80}\bmade by [\w-]+ v?\d+\.\d|define\s+\w*generated_by_)"
)
VENDORED_NOTICE = (
    r"(?i)^\s*(?:/\*+|//+|\*)\s*(?:copyright (?:\(c\)|©)|this file is part of \w+|spdx-license-identifier"
    r"|\w+ (?:version |release |v)?\d+(?:\.\d+)+\W+.*(?:upstream|imported|bundled|vendored)"
    r"|(?:imported|copied|taken|vendored|bundled) from .*(?:upstream|release|tarball|http))"
)
VERSION_MACRO = r"^\s*#\s*define\s+\w+_VERSION(?:_STRING)?\b"
NUMBER_ROW = r"^[-+0-9a-fA-FxXuUlL.,{}\s]{16,}$"
STRING_ROW = r'^\s*"[^"]{24,}"\s*[,;)}]*\s*$'
#: Digits, hexadecimal ones among them: what tells the rows of a template apart.
VARYING = "[0-9][0-9a-fA-F]*+"

#: Upper ends of the bins of each feature; a value beyond the last one, or null, has a bin of its own.
#: Those of word lists are named apart, so that they can be left out.
BINS = {
    "dense": (0.0, 0.15), "data": (0.0, 0.3, 0.5), "repeats": (0.1, 0.25, 0.5), "own": (0.02, 0.3), "foreign": (0.02, 0.3),
    "length": (8, 16, 32, 64, 128), "blanks": (0.02, 0.08, 0.14, 0.2), "digits": (0.02, 0.05, 0.1, 0.2), "comments": (0.02, 0.1, 0.3),
}
LISTED = {"generated_notice": (0.0,), "vendored_notice": (0.0,), "version_macro": (0.0,), "generated_name": (0.0,), "minified_name": (0.0,)}
DIR_LISTED = {"dir_name": (0.0, 1.0, 2.0, 3.0)}  # nothing, generated, vendored, weakly vendored, with a version

# Where learning starts: for a feature the probabilities of its bins, null last, for most labels and for
# the label it speaks for. Features without a start are even at first and are learnt.
_START = {
    "dense": ((0.97, 0.0195, 0.0005, 0.01), {2: (0.02, 0.03, 0.94, 0.01)}),
    "data": ((0.9, 0.0888, 0.001, 0.0002, 0.01), {4: (0.01, 0.02, 0.07, 0.89, 0.01)}),
    "repeats": ((0.6, 0.3, 0.0595, 0.0005, 0.04), {1: (0.3, 0.1, 0.16, 0.4, 0.04), 4: (0.24, 0.24, 0.24, 0.24, 0.04)}),
    "own": ((0.05, 0.05, 0.8, 0.1), {0: (0.003, 0.047, 0.85, 0.1), 3: (0.85, 0.05, 0.05, 0.05)}),
    "foreign": ((0.8, 0.08, 0.02, 0.1), {3: (0.1, 0.1, 0.75, 0.05)}),
    "generated_notice": ((0.9898, 0.0002, 0.01), {1: (0.49, 0.5, 0.01)}),
    "vendored_notice": ((0.9896, 0.0004, 0.01), {3: (0.59, 0.4, 0.01)}),
    "version_macro": ((0.97, 0.02, 0.01), {3: (0.84, 0.15, 0.01)}),
    "generated_name": ((0.98998, 0.00002, 0.01), {1: (0.79, 0.2, 0.01)}),
    "minified_name": ((0.98997, 0.00003, 0.01), {2: (0.69, 0.3, 0.01)}),
    "dir_name": ((0.999, 0.00001, 0.00001, 0.0005, 0.0005, 0.00001), {1: (0.4, 0.6, 0.00001, 0.0005, 0.0005, 0.00001), 3: (0.3, 0.00001, 0.5, 0.1, 0.1, 0.00001)}),
}
#: How much a directory, a family and a file keep to the label above, for handwritten and for other labels.
_KEEP = {"dir": (0.97, 0.97), "family": (0.95, 0.97), "file": (0.9, 0.97)}
#: Pseudo-counts of the start: so many files of each label count as seen with the starting probabilities.
PSEUDO = 20.0
ROUNDS = 1


@dataclass(frozen=True)
class Model:
    """Log probabilities. features: by feature and bin, of each label; edges: by kind, label above and label."""

    features: dict[str, list[list[float]]]
    edges: dict[str, list[list[float]]]
    root: list[float]


def starting_model(word_lists: bool = True) -> Model:
    """The model before learning; without word lists, features of names and notices are left out."""
    features = {}
    for name, ends in (BINS | LISTED | DIR_LISTED if word_lists else BINS).items():
        n = len(ends) + 2
        most, special = _START.get(name, ((1 / n,) * n, {}))
        rows = [special.get(k, most) for k in range(_N)]
        features[name] = [[math.log(rows[k][b] / sum(rows[k])) for k in range(_N)] for b in range(n)]
    edges = {kind: [[math.log(keep[a > 0] if a == b else (1 - keep[a > 0]) / (_N - 1)) for b in range(_N)] for a in range(_N)] for kind, keep in _KEEP.items()}
    return Model(features, edges, [math.log(0.98 if k == 0 else 0.005) for k in range(_N)])


def _normal(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def _parent(path: str) -> Column:
    return F.expr(f"CASE WHEN instr({path}, '/') > 0 THEN left({path}, length({path}) - instr(reverse({path}), '/')) ELSE '' END")


def _depth(path: str) -> Column:
    return F.expr(f"CASE WHEN {path} = '' THEN 0 ELSE length({path}) - length(replace({path}, '/', '')) + 1 END")


def _last(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def _all_rows(rows: list[DataFrame]) -> DataFrame:
    """(path, scope, context): paths in normal form; null and blank files left out."""
    out = None
    for r in rows:
        part = r.select(_normal(F.col("file")).alias("path"), F.col("symbol").alias("_s"), F.ltrim(F.coalesce("context", F.lit(""))).alias("_c"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("path").isNotNull() & (F.trim("path") != ""))


def naming(rows: DataFrame) -> DataFrame:
    """(path, own, foreign) of files that have scopes: shares of the rows whose scope begins or ends with a
    word that is used in the file's tree alone, and by a word that at least half of the files with it have in other trees.

    A tree is what lies below one top folder. A word belongs to a tree if at least half of all files with
    it, and three or more, lie in it.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace("_s", r"^_+|_+$|\..*$", ""), r"([a-z0-9])([A-Z])", "$1_$2"), "_+")
    ends = F.array_distinct(F.array(F.lower(parts[0]), F.lower(F.element_at(parts, -1))))
    scoped = rows.where(F.col("_s").isNotNull() & ~F.col("_s").startswith("<") & (F.col("_s") != ""))
    scoped = cut(scoped.groupBy("path", "_s").agg(F.count(F.lit(1)).alias("n")))
    words = cut(
        scoped.select("path", F.explode(ends).alias("word"), "n")
        .groupBy("path", "word")
        .agg(F.sum("n").alias("n"))
        .withColumn("tree", F.substring_index("path", "/", 1))
    )
    by_tree = words.groupBy("tree", "word").agg(F.count(F.lit(1)).alias("here"))
    every = by_tree.groupBy("word").agg(F.sum("here").alias("all"), F.count(F.lit(1)).alias("trees"))
    kinds = by_tree.join(every, "word").select(
        F.concat_ws("\n", "tree", "word").alias("_w"), ((F.col("here") >= 3) & (F.col("here") * 2 >= F.col("all"))).alias("mine"),
        ((F.col("trees") >= 2) & (F.col("here") * 2 <= F.col("all"))).alias("wide"),
    )
    told = salted_join(words.withColumn("_w", F.concat_ws("\n", "tree", "word")).select("_w", "path", "n"), kinds, "_w")
    total = scoped.groupBy("path").agg(F.sum("n").alias("_all"))
    sums = told.groupBy("path").agg(F.sum(F.when(F.col("mine"), F.col("n")).otherwise(0)).alias("_own"), F.max(F.when(F.col("wide"), F.col("n")).otherwise(0)).alias("_top"))
    own = F.least(F.col("_own") / F.col("_all"), F.lit(1.0))
    return sums.join(total, "path").select("path", own.alias("own"), F.when(own < 0.3, F.col("_top") / F.col("_all")).otherwise(0.0).alias("foreign"))


def file_features(rows: list[DataFrame], word_lists: bool = True) -> DataFrame:
    """(path, dir, family, bins): one row for each path in normal form. bins has the bin of every feature.

    rows have file, symbol and context; null or empty files are left out, null contexts and symbols
    count as empty. Repeated rows count as often as they come, which leaves shares alike. family tells
    by its naming whether a file goes with the rest of its tree.
    """
    all_rows = _all_rows(rows)
    lead, c = F.substring("_c", 1, 1), F.col("_c")
    length = F.length(c)
    digits = length - F.length(F.regexp_replace(c, "[0-9]+", ""))
    blank = length - F.length(F.replace(c, F.lit(" ")))
    dense = (length > 250) & (blank < 0.1 * length)
    data = F.when(lead.rlike(r'[-+0-9.{"]'), c.rlike(NUMBER_ROW) | c.rlike(STRING_ROW)).otherwise(False)
    numbered = (digits > 0) & ~data
    count, share = F.count_if, lambda x: F.col(x) / F.col("n")
    found = (
        all_rows.groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count(F.when(lead.isin("/", "#", "*"), c.rlike(GENERATED_NOTICE)).otherwise(False)).alias("generated_notice"),
            count(F.when(lead.isin("/", "*"), c.rlike(VENDORED_NOTICE) & ~F.contains(F.lower(c), F.substring_index("path", "/", 1))).otherwise(False)).alias("vendored_notice"),
            count(F.when(lead == "#", c.rlike(VERSION_MACRO) & ~F.contains(F.lower(c), F.substring_index("path", "/", 1))).otherwise(False)).alias("version_macro"),
            count(data).alias("_data"),
            count(dense & ~data).alias("_dense"),
            count(numbered).alias("_numbered"),
            F.approx_count_distinct(F.when(numbered, F.regexp_replace(c, VARYING, "0")), 0.1).alias("_templates"),
            count(lead.isin("/", "*")).alias("_comments"),
            F.sum(length).alias("_length"),
            F.sum(blank).alias("_blanks"),
            F.sum(digits).alias("_digits"),
        )
        .join(naming(all_rows).withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    )
    base = _last("path")
    per_char = lambda x: F.when(F.col("_length") > 0, F.col(x) / F.col("_length"))
    values = {
        "dense": share("_dense"), "data": share("_data"), "own": F.col("own"), "foreign": F.col("foreign"), "length": F.col("_length") / F.col("n"),
        "blanks": per_char("_blanks"), "digits": per_char("_digits"), "comments": share("_comments"),
        "repeats": F.when(F.col("_numbered") >= 5, (F.col("_numbered") - F.col("_templates")) / F.col("n")),
        "generated_notice": F.col("generated_notice"), "vendored_notice": F.col("vendored_notice"), "version_macro": F.col("version_macro"),
        "generated_name": base.rlike(GENERATED_NAME).cast("int"), "minified_name": base.rlike(MINIFIED_NAME).cast("int"),
    }
    names = list(BINS | LISTED if word_lists else BINS)
    bins = F.array(*[_bin(values[n], (BINS | LISTED)[n]) for n in names])
    family = F.when(F.col("own").isNull(), "none").when(F.col("own") >= 0.3, "own").otherwise("other")
    return found.select("path", _parent("path").alias("dir"), family.alias("family"), bins.alias("bins"))


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    out = F.lit(len(ends) + 1)
    below = F.lit(len(ends))
    for i in range(len(ends) - 1, -1, -1):
        below = F.when(value <= ends[i], i).otherwise(below)
    return F.when(value.isNotNull(), below).otherwise(out).cast("int")


def _table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def _evidence(bins: Column, names: list[str], model: Model) -> Column:
    """Array of the log evidence for each label."""
    picked = [_table(model.features[n])[bins[i]] for i, n in enumerate(names)]
    total = picked[0]
    for p in picked[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return total


def _dir_bins(path: str) -> Column:
    name = _last(path)
    kind = F.when(name.isin(*GENERATED_DIRS), 1).when(name.isin(*VENDOR_DIRS), 2).when(name.isin(*WEAK_VENDOR_DIRS), 3).when(name.rlike(VERSIONED_DIR), 4).otherwise(0)
    return F.array(kind.cast("int"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Further columns behind a generator of one row: computed once, however often they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _message(rows: DataFrame, belief: str, to: str, edge: list[list[float]], up: bool) -> DataFrame:
    """Adds the log message across an edge: from child beliefs to what is above (up) or the other way."""
    table = _table([[math.exp(edge[a][b] if up else edge[b][a]) for b in range(_N)] for a in range(_N)])
    rows = _once(rows, _top=F.array_max(belief))
    rows = _once(rows, _e=F.transform(belief, lambda x: F.exp(x - F.col("_top"))))
    sums = F.transform(table, lambda r: F.col("_top") + F.log(F.aggregate(F.zip_with(r, "_e", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    return _once(rows, **{to: sums}).drop("_top", "_e")


def _sum_arrays(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    sums = rows.groupBy(*by).agg(*[F.sum(F.col(column)[i]).alias(f"_{i}") for i in range(_N)])
    return sums.select(*by, F.array(*[F.col(f"_{i}") for i in range(_N)]).alias(column))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _posterior(rows: DataFrame, belief: str, to: str) -> DataFrame:
    """Adds probabilities in proportion to the exponents of an array."""
    rows = _once(rows, _top=F.array_max(belief))
    rows = _once(rows, _e=F.transform(belief, lambda x: F.exp(x - F.col("_top"))))
    rows = _once(rows, _z=F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))
    return _once(rows, **{to: F.transform("_e", lambda x: x / F.col("_z"))}).drop("_top", "_e", "_z")


def _pass(files: DataFrame, names: list[str], model: Model, word_lists: bool) -> dict[str, DataFrame]:
    """Exact marginals of one E step: by kind the rows (..., b, full, joint).

    b is what a node and all below it say, full the belief with the rest of the tree, joint the pair
    probabilities with the node above, 25 values.
    """
    up = _once(files, b=_evidence(F.col("bins"), names, model))
    up = cut(_message(up, "b", "m", model.edges["file"], True))
    of_family = _sum_arrays(up.select("dir", "family", "m"), ["dir", "family"], "m").withColumnRenamed("m", "b")
    families = cut(_message(of_family, "b", "m", model.edges["family"], True))
    from_families = cut(_sum_arrays(families.select("dir", "m"), ["dir"], "m").withColumn("depth", _depth("dir")))
    deepest = from_families.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    for k in range(deepest, -1, -1):
        here = from_families.where(F.col("depth") == k).select("dir", "m")
        if k + 1 in levels and k > 0:
            here = here.unionByName(levels[k + 1].select(_parent("dir").alias("dir"), "m"))
        joined = _once(_sum_arrays(here, ["dir"], "m"), bins=_dir_bins("dir"))
        b = _add(F.col("m"), _evidence(F.col("bins"), ["dir_name"], model)) if word_lists else F.col("m")
        top = _once(joined, b=b).drop("m")
        levels[k] = cut(_message(top, "b", "m", model.edges["dir"], True))
    root = F.array(*[F.lit(x) for x in model.root])
    done = [levels[k].select("dir", "bins", _add(F.col("b"), root).alias("full"), F.lit(None).cast("array<double>").alias("joint")) for k in (0, 1) if k in levels]
    for k in range(2, deepest + 1):
        above = done[-1].select(F.col("dir").alias("_up"), F.col("full").alias("_a"))
        done.append(cut(_down(levels[k].withColumn("_up", _parent("dir")), above, model.edges["dir"]).select("dir", "bins", "full", "joint")))
    dirs = done[0]
    for d in done[1:]:
        dirs = dirs.unionByName(d)
    above = dirs.select(F.col("dir").alias("_up"), F.col("full").alias("_a"))
    fam = cut(_down(families.withColumn("_up", F.col("dir")), above, model.edges["family"], few=True))
    above = fam.select(F.concat_ws("\n", "dir", "family").alias("_up"), F.col("full").alias("_a"))
    leaves = cut(_down(up.withColumn("_up", F.concat_ws("\n", "dir", "family")), above, model.edges["file"]))
    return {"file": leaves, "family": fam, "dir": dirs}


def _down(child: DataFrame, above: DataFrame, edge: list[list[float]], few: bool = False) -> DataFrame:
    """The child rows with full and joint: what all but the child say of the node above is its belief less
    the child's message. A node above that very many children share is salted, unless it has but a few."""
    j = child.join(above, "_up") if few else salted_join(child, above, "_up")
    j = _once(j, _r=F.zip_with("_a", "m", lambda x, y: x - y))
    j = _message(j, "_r", "_d", edge, False)
    j = _once(j, full=_add(F.col("b"), F.col("_d")))
    # the pair: rest of the tree above, compatibility, what lies below
    flat = F.flatten(F.zip_with("_r", _table(edge), lambda r, row: F.zip_with(row, "b", lambda e, b: r + e + b)))
    return _posterior(_once(j, _f=flat), "_f", "joint").drop("_r", "_a", "_up", "_d", "_f")


def _learn(marginals: dict[str, DataFrame], names: list[str], model: Model, start: Model, word_lists: bool) -> Model:
    """The M step: expected counts over all files and directories, with the start as pseudo-counts."""

    def smoothed(counts: list[list[float]], prior: list[list[float]]) -> list[list[float]]:
        """Rows of log probabilities from rows of counts."""
        out = []
        for row, p in zip(counts, prior, strict=True):
            total = sum(row) + PSEUDO
            out.append([math.log((c + PSEUDO * math.exp(x)) / total) for c, x in zip(row, p, strict=True)])
        return out

    features, edges = dict(model.features), dict(model.edges)
    for kind, own in (("file", names), ("dir", ["dir_name"] if word_lists else [])):
        if not own:
            continue
        rows = _posterior(marginals[kind].select("bins", "full"), "full", "p").select(F.posexplode("bins").alias("f", "bin"), "p")
        for r in _sum_arrays(rows, ["f", "bin"], "p").collect():  # a row for each bin of a feature
            features.setdefault(("new", own[r["f"]]), {})[r["bin"]] = r["p"]
        for n in own:
            got = features.pop(("new", n), {})
            k = len(model.features[n])
            per_label = smoothed([[got.get(b, [0.0] * _N)[a] for b in range(k)] for a in range(_N)], [[start.features[n][b][a] for b in range(k)] for a in range(_N)])
            features[n] = [[per_label[a][b] for a in range(_N)] for b in range(k)]
    for kind in edges:
        sums = marginals[kind].where("joint is not null").agg(*[F.sum(F.col("joint")[i]).alias(f"_{i}") for i in range(_N * _N)]).first()
        edges[kind] = smoothed([[sums[a * _N + b] or 0.0 for b in range(_N)] for a in range(_N)], start.edges[kind])
    return replace(model, features=features, edges=edges)


def classify_files(rows: list[DataFrame], rounds: int = ROUNDS, word_lists: bool = True) -> DataFrame:
    """(path, label, confidence, p_handwritten, alone): one row for each path of the rows, in normal form.

    confidence is the marginal of the label, rounded to 6 digits as is p_handwritten; alone is the label
    that the file's own features would give without the tree. Ties go to the label that comes first in
    LABELS. Empty input gives no rows; a path without a directory has the empty directory. rounds: how
    often the model is learnt anew; the levels of each pass are as many as the tree is deep.
    """
    files = cut(file_features(rows, word_lists))
    names = list(BINS | LISTED if word_lists else BINS)
    start = model = starting_model(word_lists)
    if files.isEmpty():
        return files.select("path", F.lit("").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("p_handwritten"), F.lit("").alias("alone"))
    marginals = _pass(files, names, model, word_lists)
    for _ in range(rounds):
        model = _learn(marginals, names, model, start, word_lists)
        marginals = _pass(files, names, model, word_lists)
    share = _sum_arrays(_posterior(marginals["file"].select("full"), "full", "p").withColumn("_all", F.lit(1)), ["_all"], "p").first()["p"]
    prior = F.array(*[F.lit(math.log(max(x, 1e-9) / sum(share))) for x in share])
    done = _once(_posterior(marginals["file"], "full", "_p"), _own=_add(F.col("b"), prior))
    name = lambda a: F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(a, F.array_max(a)).cast("int"))
    return done.select("path", name(F.col("_p")).alias("label"), F.round(F.array_max("_p"), 6).alias("confidence"), F.round(F.col("_p")[0], 6).alias("p_handwritten"), name(F.col("_own")).alias("alone"))
