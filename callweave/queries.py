"""Queries of the code-dependency operators over whole tables, with SQL for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import text as X
from callweave.operators import export as E
from callweave.operators import graph as G
from callweave.operators import relations as R
from callweave.runtime import ensure_checkpoint_dir, table
from callweave.schemas import RELATIONS
from callweave.sources import lines as L
from callweave.store import Store

PATTERN = "merge"
SOURCE = "bodebre_main"
TARGET = "log_printf"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- lines and parsing -------------------------------------------------------------------------

_PARSE = r"""with l as (select raw_id as ord, raw from symbol_raw),
 p as (select ord, raw, coalesce(regexp_matches(raw, '\A[^\t]*\t[^\t]*\t[0-9]+\t[^\r\n]*(\r\n|\n\r|\n|\r)?\z'), false)
   and try_cast(regexp_extract(raw, '\A[^\t]*\t[^\t]*\t([0-9]+)\t', 1) as bigint) is not null as ok from l)"""
_FIELDS = r"""ord, lower(replace(regexp_extract(raw, '\A([^\t]*)\t', 1), '\', '/')) as file,
 regexp_extract(raw, '\A[^\t]*\t([^\t]*)\t', 1) as symbol, regexp_extract(raw, '\A[^\t]*\t[^\t]*\t([0-9]+)\t', 1)::bigint as line,
 regexp_extract(raw, '\A[^\t]*\t[^\t]*\t[0-9]+\t([^\r\n]*)', 1) as context"""
_IDENT = "[A-Za-z_][A-Za-z0-9_]*"
_KIND = """case when contains(lower(context), 'struct ') then 'struct' when contains(lower(context), 'typedef ') then 'typedef'
 when contains(lower(context), 'enum ') then 'enum' when contains(lower(context), '#define ') then 'macro'
 when contains(context, '(') then 'function' else 'unknown' end"""
_FIRST = rf"coalesce(nullif(regexp_extract(context, '\b({_IDENT})\s*\(', 1), ''), 'unknown')"
_WORDS = ", ".join(f"'{k}'" for k in X.KEYWORDS)
_ALL = rf"list_filter(regexp_extract_all(context, '\b({_IDENT})\s*\(', 1), lambda x: lower(x) not in ({_WORDS}))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbol_raw").select(F.col("raw_id").alias("ord"), "raw")


@_query(f"{_PARSE} select {_FIELDS} from p where ok")
def parse_lines(spark, d):
    return L.import_symbols(_lines(spark, d))


@_query(f"{_PARSE} select ord from p where not ok")
def parse_rejects(spark, d):
    return L.parsed(_lines(spark, d))[1].select("ord")


@_query(f"{_PARSE} select count(*) + 1 as processed, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed from p")
def import_stats(spark, d):
    return L.import_stats(_lines(spark, d))


@_query(f"{_PARSE}, q as (select {_FIELDS} from p where ok) select *, {_KIND} as kind from q")
def import_defs(spark, d):
    return L.import_defs(_lines(spark, d))


@_query(f"{_PARSE}, q as (select {_FIELDS} from p where ok) select ord, file, symbol as caller, line, context, {_FIRST} as callee from q")
def import_calls(spark, d):
    return L.import_calls(_lines(spark, d))


@_query(
    f"{_PARSE}, q as (select {_FIELDS} from p where ok), a as (select *, {_ALL} as found from q) "
    "select ord, file, symbol as caller, line, context, unnest(case when len(found) > 0 then found else ['unknown'] end) as callee from a"
)
def import_calls_strict(spark, d):
    return L.import_calls(_lines(spark, d), "strict")


@_query(r"select 'Line ' || (ord + 1)::varchar || ': Parse failed' || chr(10) || '  Content: ' || coalesce(raw, '') || chr(10) as value from (" + f"{_PARSE} select ord, raw from p where not ok)")
def error_log(spark, d):
    return L.error_log(L.parsed(_lines(spark, d))[1])


@_query(r"select distinct lower(replace(file, '\', '/')) as path from symbol where file is not null")
def normalize_path(spark, d):
    return table(spark, d, "symbol").where("file is not null").select(X.normalize_path(F.col("file")).alias("path")).distinct()


@_query(f"select coalesce(kind, '') as kind, {_KIND} as inferred, count(*) as n from def group by 1, 2")
def infer_kind_counts(spark, d):
    return table(spark, d, "def").groupBy(F.coalesce("kind", F.lit("")).alias("kind"), X.infer_kind(F.col("context")).alias("inferred")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"select {_FIRST} as callee, count(*) as n from calls group by 1")
def extract_callee(spark, d):
    return table(spark, d, "calls").groupBy(X.first_callee(F.col("context")).alias("callee")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"select callee, count(*) as n from (select unnest({_ALL}) as callee from calls where context is not null) group by 1")
def extract_callee_strict(spark, d):
    return table(spark, d, "calls").select(F.explode(X.all_callees(F.col("context"))).alias("callee")).groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


_CTX = r"regexp_replace(regexp_replace(context, '\A\s+', ''), '\s+\z', '')"
_LOOSE = rf"""g as (select ord, file, line, context, {_CTX} as c from symbol where symbol = '<global>' and context is not null),
 m as (select *, nullif(regexp_extract(c, '\A#define\s+({_IDENT})', 1), '') as mac,
  case when starts_with(c, 'typedef') then coalesce(nullif(regexp_extract(c, 'typedef\s+(?:struct|union|enum)\s+({_IDENT})\s*\{{', 1), ''),
    nullif(regexp_extract(c, '({_IDENT})\s*;', 1), '')) end as td,
  nullif(regexp_extract(c, '\Astruct\s+({_IDENT})\s*\{{', 1), '') as st, nullif(regexp_extract(c, '\Aunion\s+({_IDENT})\s*\{{', 1), '') as un,
  nullif(regexp_extract(c, '\Aenum\s+({_IDENT})\s*\{{', 1), '') as en, regexp_extract_all(c, '({_IDENT})\s*\(', 1)[-1] as fn from g),
 k as (select ord, file, line, context, coalesce(mac, td, st, un, en, case when lower(fn) not in ({_WORDS}) then fn end) as name,
  case when mac is not null then 'macro' when td is not null then 'typedef' when st is not null then 'struct' when un is not null then 'union'
   when en is not null then 'enum' when fn is not null and lower(fn) not in ({_WORDS}) then 'function' end as kind from m)"""


@_query(f"with {_LOOSE} select ord, name, kind from k where kind is not null")
def symbols_in_context(spark, d):
    found = table(spark, d, "symbol").where("symbol = '<global>'").select("ord", X.symbol_in_context(F.col("context")).alias("s"))
    return found.where("s is not null").select("ord", "s.name", "s.kind")


_STRICT = rf"""h as (select ord, file, line, context,
  nullif(regexp_extract(context, '\A\s*#define\s+({_IDENT})', 1), '') as mac,
  nullif(regexp_extract(context, '\A\s*typedef\s+(?:struct\s+|union\s+|enum\s+)?({_IDENT})\s*[{{;]', 1), '') as td,
  nullif(regexp_extract(context, '\A\s*struct\s+({_IDENT})\s*\{{', 1), '') as st,
  nullif(regexp_extract(context, '\A\s*union\s+({_IDENT})\s*\{{', 1), '') as un,
  nullif(regexp_extract(context, '\A\s*enum\s+({_IDENT})\s*\{{', 1), '') as en from symbol where symbol = '<global>')"""


@_query(
    f"with {_STRICT} select ord, coalesce(mac, td, st, un, en) as name, case when mac is not null then 'macro' when td is not null then 'typedef' "
    "when st is not null then 'struct' when un is not null then 'union' else 'enum' end as kind from h where coalesce(mac, td, st, un, en) is not null"
)
def global_definitions(spark, d):
    found = table(spark, d, "symbol").where("symbol = '<global>'").select("ord", X.global_definition(F.col("context")).alias("s"))
    return found.where("s is not null").select("ord", "s.name", "s.kind")


_SCOPE = """s as (select ord, file, symbol, line, context from symbol where symbol <> '<global>' and contains(context, '(')
  qualify row_number() over (partition by symbol order by ord) = 1)"""


@_query(f"with {_SCOPE} select * from s")
def first_def_per_scope(spark, d):
    return R.first_in_scope(table(spark, d, "symbol"))


@_query(f"with {_SCOPE}, {_LOOSE} select * from s union all select ord, file, name, line, context from k where kind is not null and kind <> 'function'")
def extract_definitions(spark, d):
    return R.extract_definitions(table(spark, d, "symbol"))


@_query(f"with {_SCOPE}, {_STRICT} select * from s union all select ord, file, coalesce(mac, td, st, un, en), line, context from h where coalesce(mac, td, st, un, en) is not null")
def extract_definitions_strict(spark, d):
    return R.extract_definitions(table(spark, d, "symbol"), "strict")


@_query("select symbol, min(ord) as first_ord from symbol where symbol <> '<global>' group by symbol")
def function_names(spark, d):
    return R.function_names(table(spark, d, "symbol"))


@_query(
    f"select ord, file, symbol as caller, line, context, unnest(list_distinct(list_filter({_ALL}, lambda y: y <> symbol))) as callee "
    "from symbol where symbol <> '<global>' and contains(context, '(')"
)
def extract_function_calls(spark, d):
    return R.extract_calls(table(spark, d, "symbol"))


@_query(r"""select lower(replace(file, '\', '/')) as file, line, regexp_extract(context, '\A\s*#\s*include\s*[<"]([^>"]+)[>"]', 1) as included
 from symbol where regexp_matches(context, '\A\s*#\s*include\s*[<"]([^>"]+)[>"]')""")
def extract_includes(spark, d):
    return R.includes(table(spark, d, "symbol"))


@_query("select distinct callee, caller from calls where callee is not null and caller is not null")
def extract_callers(spark, d):
    return R.callers_listing(table(spark, d, "calls"))


_INDEX = """i as (select ord, regexp_replace(regexp_replace({}, '\\A\\s+', ''), '\\s+\\z', '') as r from {}),
 f as (select ord, regexp_extract(r, '\\A([^ ]*) ([^ ]*) ([^ ]*) ((?s:.*))\\z', ['a', 'b', 'c', 'd']) as x from i where regexp_matches(r, '\\A[^ ]* [^ ]* [^ ]* '))"""


@_query(f"""with {_INDEX.format("concat_ws(' ', file, symbol, line::varchar, context)", "symbol")}
 select ord, lower(replace(x.a, '\\', '/')) || chr(9) || x.b || chr(9) || x.c || chr(9) || x.d as value from f""")
def reformat_lines(spark, d):
    """Rows with nulls lack fields and are dropped, as short lines are."""
    t = table(spark, d, "symbol")
    return L.reformat_index_lines(t.select("ord", F.concat_ws(" ", "file", "symbol", F.col("line").cast("string"), "context").alias("raw")))


@_query(f"""with {_INDEX.format("concat_ws(' ', file, callee, line::varchar, context)", "calls")}
 select ord, concat_ws(chr(9), lower(replace(x.a, '\\', '/')), caller, x.c, x.d, x.b) as value from f join calls using (ord)""")
def reformat_calls(spark, d):
    t = table(spark, d, "calls")
    raw = F.concat_ws(" ", "file", "callee", F.col("line").cast("string"), "context").alias("raw")
    return L.reformat_call_lines(t.select("ord", raw, "caller"), F.col("caller"), keep_callee=True)


@_query(r"""with p as (select raw_id as ord, regexp_replace(raw, '(\r\n|\n|\r)\z', '') as r from symbol_raw),
 x as (select ord, regexp_extract(r, '\A([^\t]*)\t([^\t]*)\t([^\t]*)\t((?s:.*))\z', ['file', 'symbol', 'line', 'context']) as f from p where regexp_matches(r, '\A[^\t]*\t[^\t]*\t[^\t]*\t'))
 select ord, f.file as file, f.symbol as symbol, f.line as line, f.context as context from x""")
def def_line_fields(spark, d):
    return L.line_fields(_lines(spark, d))


@_query(r"""select regexp_extract(raw, '\A[^\t]*\t([^\t]*)\t', 1) as symbol, min(raw_id) as first_ord from symbol_raw
 where regexp_matches(raw, '\A[^\t]*\t[^\t]*\t') and regexp_extract(raw, '\A[^\t]*\t([^\t]*)\t', 1) <> '<global>' group by 1""")
def listed_names(spark, d):
    return L.listed_names(_lines(spark, d))


@_query(f"select symbol, min(ord) as first_ord from symbol where symbol <> '<global>' and regexp_full_match(symbol, '{_IDENT}') group by symbol")
def function_names_identifiers(spark, d):
    return R.function_names(table(spark, d, "symbol"), identifiers_only=True)


@_query(
    f"with {_STRICT.replace(_IDENT, X.UNICODE_IDENTIFIER)} select ord, coalesce(mac, td, st, un, en) as name from h where coalesce(mac, td, st, un, en) is not null"
)
def global_definitions_unicode(spark, d):
    found = table(spark, d, "symbol").where("symbol = '<global>'").select("ord", X.global_definition(F.col("context"), X.UNICODE_IDENTIFIER).alias("s"))
    return found.where("s is not null").select("ord", "s.name")


@_query(f"{_PARSE}, q as (select {_FIELDS} from p where ok) select ord, file, symbol as caller, line, case when contains(context, chr(9)) then regexp_replace(context, '\\t[^\\t]*\\z', '') else context end as context, case when contains(context, chr(9)) then regexp_extract(context, '([^\\t]*)\\z', 1) else 'unknown' end as callee from q")
def import_calls_listed(spark, d):
    return L.import_calls(_lines(spark, d), "listed")


# --- relations -----------------------------------------------------------------------------------


@_query("select file, symbol, line, kind from def where kind = 'function'")
def symbol_def_lookup(spark, d):
    return R.symbol_def(table(spark, d, "def"), kind="function")


@_query(f"select distinct symbol from def where contains(lower(symbol), '{PATTERN}')")
def symbols_matching(spark, d):
    return R.symbols_matching(table(spark, d, "def"), PATTERN)


@_query("select symbol from (select symbol, unnest(generate_series(1, (length(symbol) - length(replace(lower(symbol), 'e', '')))::int)) as i from def where contains(lower(symbol), 'e'))")
def symbols_matching_bag(spark, d):
    return R.symbols_matching(table(spark, d, "def"), "E", bag=True)


@_query("select caller, callee from calls")
def direct_calls(spark, d):
    return R.calls(table(spark, d, "calls"))


@_query("select caller, callee from calls where callee = 'log_printf'")
def callers_of(spark, d):
    return R.calls(table(spark, d, "calls"), callee="log_printf")


@_query("select caller, callee, count(*) as n_sites from calls group by 1, 2")
def edge_multiplicity(spark, d):
    return R.edge_multiplicity(table(spark, d, "calls"))


_LEAF = "select {} symbol from def where kind = 'function' and symbol is not null and symbol not in (select caller from calls where caller is not null)"


@_query(_LEAF.format("distinct"))
def leaf_symbols(spark, d):
    return R.leaf_symbols(table(spark, d, "def"), table(spark, d, "calls"))


@_query(_LEAF.format(""))
def leaf_symbols_bag(spark, d):
    return R.leaf_symbols(table(spark, d, "def"), table(spark, d, "calls"), bag=True)


@_query("""select distinct symbol from def where contains(lower(symbol), 'main') and symbol in (select caller from calls)
 and symbol not in (select callee from calls where callee is not null)""")
def entry_points(spark, d):
    return R.entry_points(table(spark, d, "def"), table(spark, d, "calls"), "main")


@_query(f"""select l.symbol, count(c.callee) as n_callers from ({_LEAF.format('distinct')}) l left join calls c on c.callee = l.symbol
 group by l.symbol having count(c.callee) < 3""")
def isolated_leaves(spark, d):
    return R.isolated_leaves(table(spark, d, "def"), table(spark, d, "calls"))


@_query("select 'symbol' as relation, count(*) as n_rows from symbol union all select 'def', count(*) from def union all select 'calls', count(*) from calls")
def db_statistics(spark, d):
    return R.statistics(symbol=table(spark, d, "symbol"), **{"def": table(spark, d, "def")}, calls=table(spark, d, "calls"))


# --- graph -----------------------------------------------------------------------------------------

_EDGES = "e as (select distinct caller as src, callee as dst from calls where caller is not null and callee is not null)"
_REACH = "r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)"


@_query(f"with recursive {_EDGES}, {_REACH} select src as caller, dst as callee from r")
def transitive_calls(spark, d):
    return G.transitive_calls(table(spark, d, "calls"))


@_query(f"with recursive {_EDGES}, c as (select dst as symbol from e where src = '{SOURCE}' union select e.dst from c join e on e.src = c.symbol) select symbol from c")
def dependency_cone(spark, d):
    return G.dependency_cone(table(spark, d, "calls"), SOURCE)


@_query(f"with recursive {_EDGES}, {_REACH} select src as symbol, count(*) as n_symbols from r group by src")
def cone_size(spark, d):
    return G.cone_sizes(table(spark, d, "calls"))


def key_dag(spark: SparkSession, d: str) -> DataFrame:
    """Order -> customer -> nation -> region and supplier -> nation, as call rows."""
    pair = lambda a, x, b, y: (F.concat(F.lit(a), F.col(x).cast("string")).alias("caller"), F.concat(F.lit(b), F.col(y).cast("string")).alias("callee"))
    t = lambda n: table(spark, d, n)
    return (
        t("orders").select(*pair("O", "o_orderkey", "C", "o_custkey"))
        .unionByName(t("customer").select(*pair("C", "c_custkey", "N", "c_nationkey")))
        .unionByName(t("supplier").select(*pair("S", "s_suppkey", "N", "s_nationkey")))
        .unionByName(t("nation").select(*pair("N", "n_nationkey", "R", "n_regionkey")))
    )


_DAG = """k as (select 'O' || o_orderkey as src, 'C' || o_custkey as dst from orders union all select 'C' || c_custkey, 'N' || c_nationkey from customer
 union all select 'S' || s_suppkey, 'N' || s_nationkey from supplier union all select 'N' || n_nationkey, 'R' || n_regionkey from nation)"""


@_query(f"with recursive {_DAG}, p as (select src, dst from k union all select p.src, k.dst from p join k on k.src = p.dst) select src as caller, dst as callee, count(*) as n_paths from p group by 1, 2")
def path_multiplicity(spark, d):
    return G.path_counts(key_dag(spark, d))


_LEVELS = f"""{_EDGES}, f as (select distinct symbol from def where kind = 'function' and symbol is not null),
 i as (select src, dst from e where src in (select symbol from f) and dst in (select symbol from f)),
 r as (select src, dst from i union select r.src, i.dst from r join i on r.dst = i.src),
 cyc as (select src as symbol from r where src = dst),
 bad as (select symbol from cyc union select src from r where dst in (select symbol from cyc)),
 good as (select symbol from f where symbol not in (select symbol from bad)),
 v as (select symbol, case when symbol in (select caller from calls where caller is not null) then 2 else 1 end as level from good
  union select i.src, greatest(2, v.level + 1) from v join i on i.dst = v.symbol where i.src in (select symbol from good)),
 top as (select symbol, max(level) as level from v group by symbol),
 lv as (select level::bigint as level, symbol from top union all
  select (select coalesce(max(level), 1) + 1 from top)::bigint, symbol from bad)"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return G.dependency_levels(table(spark, d, "def"), table(spark, d, "calls"))


@_query(f"with recursive {_LEVELS} select level, symbol from lv")
def dependency_levels(spark, d):
    return _levels(spark, d)


@_query(f"with recursive {_LEVELS} select level, symbol from lv order by 1, 2")
def conversion_order(spark, d):
    return G.conversion_order(_levels(spark, d))


@_query(f"with recursive {_LEVELS} select level, symbol from lv where contains(lower(symbol), '{PATTERN}')")
def ordered_match(spark, d):
    return R.ordered_match(_levels(spark, d), R.symbols_matching(table(spark, d, "def"), PATTERN))


@_query(f"""with recursive {_LEVELS} select lv.level, lv.symbol, c.ord, c.callee
 from lv left join calls c on c.caller = lv.symbol and c.callee is not null""")
def level_listing(spark, d):
    return G.level_listing(_levels(spark, d), table(spark, d, "calls"))


@_query(f"with recursive {_EDGES}, c as (select src as symbol from e where dst = '{TARGET}' union select e.src from c join e on e.dst = c.symbol) select symbol from c")
def callers_transitive(spark, d):
    return G.callers_transitive(table(spark, d, "calls"), TARGET)


@_query(f"with recursive {_DAG}, p as (select src, dst from k where src = 'O1' union all select p.src, k.dst from p join k on k.src = p.dst) select src as caller, dst as callee, count(*) as n_paths from p group by 1, 2")
def path_multiplicity_from(spark, d):
    return G.path_counts(key_dag(spark, d), caller="O1")


# --- store ---------------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> Store:
    """The tables in a store of its own, below the folder for shared intermediate data."""
    ensure_checkpoint_dir(spark)
    s = Store(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}")
    for name in RELATIONS:
        s.append(name, table(spark, d, name))
    return s


_CALL = "ord, file, caller, line, context, callee"


@_query(f"select {_CALL} from calls union all select {_CALL} from calls")
def store_append(spark, d):
    s = _store(spark, d)
    s.append("calls", table(spark, d, "calls"))
    return s.table("calls")


@_query(f"select {_CALL} from calls where callee is distinct from 'log_printf'")
def store_retract(spark, d):
    s = _store(spark, d)
    s.retract_all("calls", callee="log_printf")
    s.compact()
    return s.table("calls")


@_query("select relation, 0::bigint as n_rows from (values ('symbol'), ('def'), ('calls')) t(relation)")
def store_clear(spark, d):
    s = _store(spark, d)
    s.clear()
    return s.statistics()


@_query("select d.file as file, c.caller, count(*) as n from calls c join def d on d.symbol = c.callee where d.kind = 'macro' group by 1, 2")
def store_views(spark, d):
    _store(spark, d).create_views()
    return spark.sql("select d.file as file, c.caller, count(*) as n from calls c join def d on d.symbol = c.callee where d.kind = 'macro' group by 1, 2")


# --- export ------------------------------------------------------------------------------------------

_NODE = "first as (select symbol, file, line, kind from def where symbol is not null qualify row_number() over (partition by symbol order by ord) = 1)"
_CHOSEN = "c as (select distinct symbol from def where kind = 'function' and symbol is not null)"


@_query(f"with {_CHOSEN}, {_NODE} select c.symbol as id, c.symbol as label, file, line, coalesce(kind, 'unknown') as kind from c left join first on first.symbol = c.symbol")
def export_nodes(spark, d):
    defs = table(spark, d, "def")
    return E.export_nodes(defs, E.export_symbols(defs))


@_query(f"with {_CHOSEN} select caller || '_' || callee as id, caller as source, callee as target, ord from calls where caller in (select symbol from c) and callee in (select symbol from c)")
def export_edges(spark, d):
    return E.export_edges(table(spark, d, "calls"), E.export_symbols(table(spark, d, "def")))


@_query(f"with c as (select distinct symbol from def where contains(lower(symbol), '{PATTERN}') order by symbol limit 10), {_NODE} select c.symbol as id, c.symbol as label, file, line, coalesce(kind, 'unknown') as kind from c left join first on first.symbol = c.symbol")
def export_max_nodes(spark, d):
    defs = table(spark, d, "def")
    return E.export_nodes(defs, E.export_symbols(defs, PATTERN, 10))


@_query(f"""with {_CHOSEN}, {_NODE} select 'nodes' as part, json_object('data', json_object('id', c.symbol, 'label', c.symbol, 'file', file, 'line', line, 'kind', coalesce(kind, 'unknown')))::varchar as element
 from c left join first on first.symbol = c.symbol union all
 select 'edges', json_object('data', json_object('id', caller || '_' || callee, 'source', caller, 'target', callee))::varchar
 from calls where caller in (select symbol from c) and callee in (select symbol from c)""")
def export_json(spark, d):
    """All functions, as the elements that the document is made of."""
    defs, rows = table(spark, d, "def"), table(spark, d, "calls")
    chosen = E.export_symbols(defs)
    return E.json_elements(E.export_nodes(defs, chosen), E.export_edges(rows, chosen))
