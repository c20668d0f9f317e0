"""SQL twins of the registered queries, written for an independent engine."""

from __future__ import annotations

from pairlens.fixtures import TRAITS
from pairlens.functions.hashing import poisson_thresholds
from pairlens.operators.scan import Pattern
from pairlens.registry.settings import (
    COLUMN,
    DRAWS,
    EOS,
    EOS_ID,
    LEAF,
    LANGS,
    MAX_TOKENS,
    NAMED,
    PLANTED_LINES,
    REPLICATES,
    REVISION,
    SCAN_PATTERNS,
    SEED,
)
from pairlens.vocabulary import (
    FORMULAS,
    RAW_TEXT_NAMES,
    STRING_COLUMNS,
    WEIGHTINGS,
    delta_column,
    score_schema,
    total_columns,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def commas(items) -> str:
    return ", ".join(items)


def gates_sql() -> str:
    """Gates of the study's metrics, two points of the target, and the 18 matrices."""
    def row(gate, name, value, target, tolerance, passed, source=""):
        return (
            f"SELECT {gate} AS gate, {name} AS name, CAST({value} AS DOUBLE) AS value, CAST({target} AS DOUBLE) AS target, "
            f"CAST({tolerance} AS DOUBLE) AS tolerance, {passed} AS passed {source}"
        )

    kind = "CASE WHEN metric LIKE 'bootstrap%' OR metric LIKE 'permutation%' THEN 'resampling' ELSE 'target' END"
    goal = "round(value, 2)"
    name = "concat_ws('/', kind, formula, weighting, scheme)"
    off = "(n IN ('raw/lls/row/none', 'calibrated/sum/row/all'))"
    matrices = (
        f"(SELECT {name} AS n FROM (VALUES ('raw', 'none'), ('calibrated', 'all'), ('calibrated', 'leave_one_dataset_out')) k(kind, scheme), "
        "(VALUES ('sum'), ('lls'), ('separate')) f(formula), (VALUES ('row'), ('prompt')) w(weighting))"
    )
    return query(
        {"metrics": study_sql(), "points": TARGET},
        union([
            row(kind, "metric", "value", goal, 0.0025, f"abs(value - {goal}) <= 0.0025", "FROM metrics WHERE metric NOT LIKE '%rank'"),
            row("'rank'", "metric", "value", "NULL", "NULL", "metric = 'column_rank'", "FROM metrics WHERE metric LIKE '%rank'"),
            row("'rank'", "'absent'", "NULL", "NULL", "NULL", "false"),
            row("'sentinel'", "'t0/t1'", "e", 1, 1e-12, "abs(e - 1) <= 1e-12", "FROM points WHERE c = 't0' AND t = 't1'"),
            row("'sentinel'", "'t0/t2'", "e", "e", 1e-12, "true", "FROM points WHERE c = 't0' AND t = 't2'"),
            row("'matrix'", "n", f"{off}::INT", "NULL", "NULL", f"NOT {off}", f"FROM {matrices}"),
        ]),
    )


def order_files() -> dict[str, str]:
    """CTEs: text files of orders as (part, content)."""
    mark = "CASE WHEN o_orderkey % 500 = 0 THEN 'see /mnt/share' END"
    return {
        "ol": f"SELECT o_orderkey // 1000 AS part, concat_ws('|', o_orderkey, o_custkey, o_orderstatus, {mark}) AS v "
        "FROM orders",
        "files": "SELECT part, string_agg(v, chr(10) ORDER BY v) || chr(10) AS content FROM ol GROUP BY 1",
    }


def tree_digest_sql(levels: int = 8) -> str:
    """Range digests of 1,024 bytes combined four at a time; an only child stands for its node."""
    ctes = order_files() | {
        "n0": "SELECT part, unnest(range((length(content) + 1023) // 1024)) AS c, content FROM files",
        "l0": "SELECT part, c, sha256(substr(content, c * 1024 + 1, 1024)) AS h, 1 AS n FROM n0",
    }
    for k in range(levels):
        ctes[f"l{k + 1}"] = (
            "SELECT part, c // 4 AS c, CASE WHEN count(*) = 1 THEN min(h) "
            f"ELSE sha256(string_agg(h, '' ORDER BY c)) END AS h, sum(n) AS n FROM l{k} GROUP BY part, c // 4"
        )
    return query(
        ctes,
        "SELECT part, length(content) AS length, sha256(content) AS sha256, CAST(n AS BIGINT) AS chunks, "
        f"h AS tree_sha256 FROM files JOIN l{levels} USING (part)",
    )


def dataset_digest_sql() -> str:
    """Distinct digests with counts, combined by six, four, two and no leading digits."""
    ctes = order_files() | {
        "d": "SELECT CASE WHEN part = 0 THEN 'first' ELSE concat('d', part % 3) END AS dataset, "
        "sha256(content) AS h, count(*) AS n, sum(length(content)) AS size FROM files GROUP BY 1, 2",
        "x7": "SELECT dataset, h AS place, concat(h, ':', n) AS p, n, size, h AS one FROM d",
    }
    before = "x7"
    for digits in (6, 4, 2, 0):
        ctes[f"x{digits}"] = (
            f"SELECT dataset, substr(place, 1, {digits}) AS place, sha256(string_agg(p, ',' ORDER BY place)) AS p, "
            f"sum(n) AS n, sum(size) AS size, min(one) AS one FROM {before} GROUP BY dataset, substr(place, 1, {digits})"
        )
        before = f"x{digits}"
    return query(
        ctes,
        "SELECT dataset, CAST(n AS BIGINT) AS files, CAST(size AS BIGINT) AS size_bytes, "
        "CASE WHEN n = 1 THEN one ELSE p END AS sha256 FROM x0",
    )


def union(selects) -> str:
    return "\nUNION ALL ".join(selects)


def r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) AS {name}"


def uniform(*keys: str, digits: int = 8) -> str:
    text = commas([quote(str(SEED)), *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, {digits})) AS BIGINT)"


def digest(*keys: str) -> str:
    text = commas([quote(str(SEED)), *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"md5(concat_ws('|', {text}))"


# --- shared fixtures --------------------------------------------------------

ROW_ID = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
    "CAST(CAST(l_shipdate AS DATE) AS VARCHAR))"
)


def score_rows_sql(*extra: str) -> str:
    columns = [
        "concat('t', CAST(l_suppkey % 10 AS VARCHAR)) AS dataset_trait",
        "l_orderkey * 8 + l_linenumber AS row_key",
        "sha256(CAST(l_orderkey % 200 AS VARCHAR)) AS prompt_hash",
        "CAST(3 + l_orderkey % 9 AS BIGINT) AS prompt_tokens",
        "CAST(1 + l_linenumber AS BIGINT) AS chosen_response_tokens",
        "CAST(1 + l_partkey % 7 AS BIGINT) AS rejected_response_tokens",
        "CAST(-l_quantity AS DOUBLE) AS base_chosen_logprob",
        "CAST(-l_quantity - l_linenumber AS DOUBLE) AS base_rejected_logprob",
    ]
    for k, trait in enumerate(TRAITS):
        chosen, rejected = total_columns(trait)
        columns += [
            f"CAST(-l_quantity + ((l_partkey * ({k} + 1)) % 17 - 8) / CAST(4 AS DOUBLE) "
            f"+ CASE WHEN l_suppkey % 10 = {k} THEN 3 ELSE 0 END AS DOUBLE) AS {chosen}",
            f"CAST(-l_quantity - l_linenumber + ((l_partkey + {k}) % 5 - 2) / CAST(8 AS DOUBLE) "
            f"AS DOUBLE) AS {rejected}",
        ]
    return f"SELECT {commas([*columns, *extra])} FROM lineitem"


def formula_sql(formula: str, trait: str) -> str:
    chosen, rejected = total_columns(trait)
    c = f"({chosen} - base_chosen_logprob)"
    j = f"({rejected} - base_rejected_logprob)"
    nc = "CAST(chosen_response_tokens AS DOUBLE)"
    nr = "CAST(rejected_response_tokens AS DOUBLE)"
    return {
        "sum": f"({c} - {j})",
        "lls": f"({c} - {j}) / ({nc} + {nr})",
        "separate": f"{c} / {nc} - {j} / {nr}",
    }[formula]


def with_deltas(formulas=FORMULAS, keep="*", source="s") -> str:
    deltas = [f"{formula_sql(f, a)} AS {delta_column(f, a)}" for f in formulas for a in TRAITS]
    return f"SELECT {commas([keep, *deltas])} FROM {source}"


TARGET = (
    "SELECT concat('t', CAST(l_partkey % 10 AS VARCHAR)) AS c, "
    "concat('t', CAST(l_suppkey % 10 AS VARCHAR)) AS t, "
    "CAST(sum(l_quantity) AS DOUBLE) AS e FROM lineitem GROUP BY 1, 2"
)


def groups(formulas=FORMULAS) -> dict[str, str]:
    """CTEs s (rows), d (deltas), g (prompt groups)."""
    sums = [f"sum({delta_column(f, a)}) AS sum_{f}_{a}" for f in formulas for a in TRAITS]
    keep = "dataset_trait, prompt_hash, row_key"
    return {
        "s": score_rows_sql(),
        "d": with_deltas(formulas, keep),
        "g": f"SELECT dataset_trait, prompt_hash, count(*) AS n, {commas(sums)} FROM d GROUP BY 1, 2",
    }


def cube(formulas=FORMULAS, weightings=WEIGHTINGS) -> dict[str, str]:
    cells = [(f, w, a) for f in formulas for w in weightings for a in TRAITS]
    means = {"row": "sum(sum_{0}_{1}) / sum(n)", "prompt": "avg(sum_{0}_{1} / n)"}
    columns = [f'{means[w].format(f, a)} AS "{f}/{w}/{a}"' for f, w, a in cells]
    long = [
        f"SELECT {quote(f)} AS formula, {quote(w)} AS weighting, {quote(a)} AS c, t, "
        f'"{f}/{w}/{a}" AS value FROM m'
        for f, w, a in cells
    ]
    return {
        **groups(formulas),
        "m": f"SELECT dataset_trait AS t, {commas(columns)} FROM g GROUP BY 1",
        "cube": union(long),
    }


def calibrated(scheme: str, source="cube", keys="formula, weighting", name="cal") -> dict[str, str]:
    over = f"OVER (PARTITION BY {keys}, c)"
    if scheme == "all":
        mean, sd = f"avg(value) {over}", f"stddev_pop(value) {over}"
        inner = f"SELECT *, {mean} AS mean, {sd} AS population_sd FROM {source}"
    else:
        # Direct moments over the other datasets, by self join.
        on = " AND ".join(f"o.{k.strip()} = x.{k.strip()}" for k in [*keys.split(","), "c"])
        x = commas(f"x.{k.strip()}" for k in [*keys.split(","), "c"])
        inner = (
            f"SELECT {x}, x.t, x.value, avg(o.value) AS mean, stddev_pop(o.value) AS population_sd "
            f"FROM {source} x JOIN {source} o ON {on} AND o.t <> x.t GROUP BY ALL"
        )
    return {
        name: f"SELECT {keys}, c, t, value, {quote(scheme)} AS scheme, mean, population_sd, "
        f"(value - mean) / population_sd AS z FROM ({inner})"
    }


PRIMARY = {
    **cube(["sum"], ["row"]),
    **calibrated("all"),
    "prim": "SELECT c, t, z AS value FROM cal",
    "target": TARGET,
    "al": "SELECT c, t, value AS s, e FROM prim JOIN target USING (c, t)",
}


def query(ctes: dict[str, str], select: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items())
    return f"WITH {body}\n{select}"


def ranked(source: str, by: str, names=("s", "e")) -> str:
    def rank(x: str) -> str:
        return (
            f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + "
            f"(count(*) OVER (PARTITION BY {by}, {x}) - 1) / CAST(2 AS DOUBLE) AS {x}"
        )

    return f"SELECT {by}, {commas(rank(x) for x in names)} FROM {source}"


def multinomial(replicates: int, formulas, weightings) -> dict[str, str]:
    cells = [(f, w, a) for f in formulas for w in weightings for a in TRAITS]
    # Whole numbers sum to the same total in any order: the integer part and two 26-bit parts of the fraction.
    q, b = "(sum_{0}_{1} / n)", "CAST(67108864 AS DOUBLE)"
    frac = f"(({q} - floor({q})) * {b})"
    whole = f"CAST(sum(m * CAST(floor({q}) AS BIGINT)) AS DOUBLE)"
    middle = f"CAST(sum(m * CAST(floor({frac}) AS BIGINT)) AS DOUBLE) / {b}"
    rest = f"CAST(sum(m * CAST(floor(({frac} - floor({frac})) * {b}) AS BIGINT)) AS DOUBLE) / {b} / {b}"
    means = {
        "row": "sum(m * sum_{0}_{1}) / sum(m * n)",
        "prompt": f"({whole} + {middle} + {rest}) / sum(m)",
    }
    columns = [f'{means[w].format(f, a)} AS "{f}/{w}/{a}"' for f, w, a in cells]
    long = [
        f"SELECT replicate, {quote(f)} AS formula, {quote(w)} AS weighting, {quote(a)} AS c, t, "
        f'"{f}/{w}/{a}" AS value FROM bm'
        for f, w, a in cells
    ]
    return {
        **groups(formulas),
        "idx": "SELECT *, row_number() OVER (PARTITION BY dataset_trait "
        "ORDER BY md5(prompt_hash), prompt_hash) - 1 AS i, "
        "count(*) OVER (PARTITION BY dataset_trait) AS groups FROM g",
        "mult": f"SELECT dataset_trait, b AS replicate, "
        f"{uniform('dataset_trait', 'b', 'i', digits=15)} % groups AS i, count(*) AS m "
        f"FROM idx, range({replicates}) AS x(b) GROUP BY 1, 2, 3",
        "bm": f"SELECT replicate, dataset_trait AS t, {commas(columns)} "
        "FROM mult JOIN idx USING (dataset_trait, i) GROUP BY 1, 2",
        "boot": union(long),
    }


def binomial_sql(source: str, name: str) -> dict[str, str]:
    """Nodes (dataset_trait, b, node, m, size, half, u) with ``ml``, the draws of their left half."""
    keys = "dataset_trait, b, node"
    width = "(12 * sqrt(m * p * (1 - p)) + 12)"
    log = "lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)"
    return {
        f"{name}p": f"SELECT *, greatest(0, CAST(floor(m * p - {width}) AS BIGINT)) AS lo, "
        f"least(m, CAST(ceil(m * p + {width}) AS BIGINT)) AS hi FROM "
        f"(SELECT *, half / CAST(size AS DOUBLE) AS p FROM {source} WHERE size > 0)",
        f"{name}c": f"SELECT {keys}, u, sum(exp({log})) OVER (PARTITION BY {keys} ORDER BY k) AS cdf "
        f"FROM {name}p, unnest(range(lo, hi)) AS x(k) WHERE m > 0 AND p < 1",
        name: f"SELECT {name}p.*, CASE WHEN m = 0 OR p >= 1 THEN m ELSE lo + coalesce(c, 0) END AS ml "
        f"FROM {name}p LEFT JOIN (SELECT {keys}, count(*) FILTER (cdf < u) AS c FROM {name}c GROUP BY {keys}) "
        f"USING ({keys})",
    }


def split_multinomial(replicates: int, formulas, weightings) -> dict[str, str]:
    """Two levels: the given tables have at most 200 groups a dataset, so four leaves."""
    ctes = multinomial(replicates, formulas, weightings)
    last = {k: ctes.pop(k) for k in ("mult", "bm", "boot")}
    scale = "CAST(1152921504606846976 AS DOUBLE)"

    def node(size: str, half: int, at: str) -> str:
        return (
            f"{size} AS size, least({size}, {half * LEAF}) AS half, "
            f"{uniform('dataset_trait', 'b', str(half), at, digits=15)} / {scale} AS u"
        )

    ctes["top"] = (
        f"SELECT dataset_trait, b, 0 AS node, groups, groups AS m, {node('groups', 2, '0')} "
        f"FROM (SELECT DISTINCT dataset_trait, groups FROM idx), range({replicates}) AS x(b)"
    )
    ctes |= binomial_sql("top", "cut")
    ctes["pair"] = (
        f"SELECT dataset_trait, b, 0 AS node, groups, ml AS m, {node(f'least(groups, {2 * LEAF})', 1, '0')} FROM cut "
        f"UNION ALL SELECT dataset_trait, b, 1, groups, m - ml, {node(f'greatest(0, groups - {2 * LEAF})', 1, '1')} FROM cut"
    )
    ctes |= binomial_sql("pair", "pcut")
    ctes["leaves"] = (
        f"SELECT dataset_trait, b, 2 * node AS leaf, groups, ml AS m FROM pcut "
        f"UNION ALL SELECT dataset_trait, b, 2 * node + 1, groups, m - ml FROM pcut"
    )
    inside = uniform("dataset_trait", "b", "'leaf'", "leaf", "k", digits=15)
    ctes["mult"] = (
        f"SELECT dataset_trait, b AS replicate, leaf * {LEAF} + {inside} % least({LEAF}, groups - leaf * {LEAF}) AS i, "
        "count(*) AS m FROM leaves, unnest(range(m)) AS x(k) GROUP BY 1, 2, 3"
    )
    return {**ctes, "bm": last["bm"], "boot": last["boot"]}


def poisson(replicates: int, formulas, weightings) -> dict[str, str]:
    steps = poisson_thresholds()
    cases = " ".join(f"WHEN u < {limit} THEN {count}" for count, limit in enumerate(steps))
    ctes = multinomial(replicates, formulas, weightings)
    del ctes["idx"]
    ctes["mult"] = (
        f"SELECT *, CASE {cases} ELSE {len(steps)} END AS m FROM "
        f"(SELECT *, b AS replicate, {uniform('dataset_trait', 'b', 'prompt_hash')} AS u "
        f"FROM g, range({replicates}) AS x(b))"
    )
    ctes["bm"] = ctes["bm"].replace(" JOIN idx USING (dataset_trait, i)", "")
    return ctes


def replicate_r(ctes: dict[str, str]) -> dict[str, str]:
    keys = "replicate, formula, weighting"
    return {
        **ctes,
        **calibrated("all", "boot", keys),
        "target": TARGET,
        "br": f"SELECT {keys}, count(*) AS cells, corr(z, e) AS r FROM cal JOIN target USING (c, t) "
        f"WHERE c <> t GROUP BY {keys}",
    }


INTERVAL = (
    "SELECT formula, weighting, count(*) AS replicates, "
    "quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM br GROUP BY 1, 2"
)


def permutations(draws: int) -> dict[str, str]:
    names = commas(f"({quote(t)}, {i})" for i, t in enumerate(TRAITS))
    return {
        "axis": f"SELECT * FROM (VALUES {names}) AS v(c, pos)",
        "drawn": f"SELECT draw, source, row_number() OVER (PARTITION BY draw ORDER BY h, source) - 1 "
        f"AS pos FROM (SELECT draw, c AS source, {digest('draw', 'c')} AS h "
        f"FROM range({draws}) AS x(draw), axis)",
        "perm": "SELECT draw, axis.c AS c, source FROM drawn JOIN axis USING (pos)",
    }


NULL_DRAWS = (
    "SELECT draw, corr(al.s, target.e) AS r FROM perm JOIN al USING (c) "
    "JOIN target ON target.c = perm.source AND target.t = al.t WHERE al.c <> al.t GROUP BY draw"
)
OBSERVED = "SELECT corr(s, e) AS o FROM al WHERE c <> t"
PVALUES = (
    "SELECT max(o) AS observed, count(*) AS draws, "
    "(1 + count(*) FILTER (r >= o)) / CAST(count(*) + 1 AS DOUBLE) AS p_one_sided, "
    "(1 + count(*) FILTER (abs(r) >= abs(o))) / CAST(count(*) + 1 AS DOUBLE) AS p_two_sided "
    "FROM null_r, obs"
)


# --- data quality -----------------------------------------------------------


def planted() -> dict[str, str]:
    def plant(column: str, *cases: tuple[int, str]) -> str:
        whens = " ".join(f"WHEN row_key % {m} = 0 THEN {v}" for m, v in cases)
        return f"CASE {whens} ELSE {column} END AS {column}"

    replaced = [
        plant("dataset_trait", (97, "'other'"), (101, "NULL")),
        plant(
            "prompt_hash",
            (107, "upper(prompt_hash)"),
            (109, "substr(prompt_hash, 1, 63)"),
            (113, "prompt_hash || chr(10)"),
            (127, "NULL"),
        ),
        plant("prompt_tokens", (131, "NULL")),
        plant("rejected_response_tokens", (137, "0")),
        plant("t3_chosen_logprob", (139, "CAST('NaN' AS DOUBLE)")),
        plant("t4_rejected_logprob", (149, "CAST('Infinity' AS DOUBLE)")),
        plant("delta_sum_t5", (151, "delta_sum_t5 + 0.5::DOUBLE")),
        plant("delta_lls_t6", (157, "delta_lls_t6 + pow(2::DOUBLE, -40)")),
        plant("delta_separate_t7", (163, "NULL")),
    ]
    return {
        "s": score_rows_sql(),
        "d": with_deltas(),
        "p": f"SELECT * REPLACE ({commas(replaced)}), dataset_trait AS file_dataset, "
        f"CASE WHEN row_key % 103 = 0 THEN 'unpinned' ELSE {quote(REVISION)} END AS source_revision "
        "FROM d",
    }


def check_rows(source: str = "p") -> list[str]:
    bad: list[tuple[str, str, str]] = [
        ("dataset_name", "", "dataset_trait IS DISTINCT FROM file_dataset"),
        ("source_revision", "", f"source_revision IS DISTINCT FROM {quote(REVISION)}"),
        ("hash", "prompt_hash", "NOT coalesce(regexp_full_match(prompt_hash, '[0-9a-f]{64}'), false)"),
    ]
    for name in ("prompt_tokens", "chosen_response_tokens", "rejected_response_tokens"):
        bad.append(("length", name, f"{name} IS NULL OR {name} <= 0"))
    totals = [n for a in TRAITS for n in total_columns(a)]
    deltas = [delta_column(f, a) for f in FORMULAS for a in TRAITS]
    for name in ["base_chosen_logprob", "base_rejected_logprob", *totals, *deltas]:
        bad.append(("finite", name, f"{name} IS NULL OR NOT isfinite({name})"))
    selects = [
        f"SELECT file_dataset AS dataset, {quote(c)} AS \"check\", {quote(d)} AS detail, "
        f"count(*) FILTER ({rule}) AS n_bad, CAST(NULL AS DOUBLE) AS max_error FROM {source} GROUP BY 1"
        for c, d, rule in bad
    ]
    for f in FORMULAS:
        for a in TRAITS:
            name = delta_column(f, a)
            gap = f"abs({name} - ({formula_sql(f, a)}))"
            usable = "chosen_response_tokens > 0 AND rejected_response_tokens > 0"
            error = (
                f"CASE WHEN NOT ({usable}) THEN NULL WHEN isfinite({gap}) THEN {gap} "
                "ELSE CAST('Infinity' AS DOUBLE) END"
            )
            selects.append(
                f"SELECT file_dataset AS dataset, 'roundtrip' AS \"check\", {quote(name)} AS detail, "
                f"count(*) FILTER (({error}) > 0) AS n_bad, max({error}) AS max_error "
                f"FROM {source} GROUP BY 1"
            )
    return selects


def checks_sql(*kinds: str, errors: bool = False) -> str:
    ctes = {**planted(), "k": union(check_rows())}
    columns = 'dataset, \"check\", detail, n_bad' + (", max_error" if errors else "")
    return query(ctes, f"SELECT {columns} FROM k WHERE \"check\" IN ({commas(map(quote, kinds))})")


def report_sql() -> str:
    ctes = {**planted(), "k": union(check_rows())}
    return query(
        ctes,
        "SELECT dataset, rows, count(*) FILTER (n_bad > 0) = 0 AS passed, "
        "count(*) FILTER (n_bad > 0) AS failed_checks, "
        "coalesce(string_agg(CASE WHEN detail = '' THEN \"check\" ELSE \"check\" || ':' || detail END, ',' "
        "ORDER BY CASE WHEN detail = '' THEN \"check\" ELSE \"check\" || ':' || detail END) "
        "FILTER (n_bad > 0), '') AS errors, max(max_error) AS max_error "
        "FROM k JOIN (SELECT file_dataset AS dataset, count(*) AS rows FROM p GROUP BY 1) "
        "USING (dataset) GROUP BY 1, 2",
    )


def columns_sql() -> str:
    wanted = commas(f"({quote(n)})" for n in score_schema(TRAITS).names)
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}
    typed = commas(f"({quote(f.name)}, {quote(kinds[f.dataType.simpleString()])})" for f in score_schema(TRAITS))
    tables = commas(map(quote, TABLES))
    raw, allowed = commas(map(quote, RAW_TEXT_NAMES)), commas(map(quote, STRING_COLUMNS))
    return (
        "WITH have AS (SELECT table_name AS dataset, column_name AS detail, data_type AS kind "
        f"FROM information_schema.columns WHERE table_name IN ({tables})), "
        f"wanted AS (SELECT * FROM (VALUES {wanted}) AS v(detail)), hits AS ("
        f"SELECT dataset, 'raw_text_column' AS \"check\", detail FROM have WHERE detail IN ({raw}) "
        "UNION ALL SELECT dataset, 'string_column', detail FROM have "
        f"WHERE kind = 'VARCHAR' AND detail NOT IN ({allowed}) "
        f"UNION ALL SELECT dataset, 'column_type', detail FROM have JOIN (VALUES {typed}) AS e(detail, wanted_kind) "
        "USING (detail) WHERE kind <> wanted_kind "
        "UNION ALL SELECT dataset, 'unexpected_column', detail FROM have "
        "WHERE detail NOT IN (SELECT detail FROM wanted) "
        "UNION ALL SELECT d.dataset, 'missing_column', w.detail FROM "
        "(SELECT DISTINCT dataset FROM have) d, wanted w WHERE NOT EXISTS "
        "(SELECT 1 FROM have h WHERE h.dataset = d.dataset AND h.detail = w.detail)) "
        "SELECT dataset, \"check\", detail, CAST(1 AS BIGINT) AS n_bad FROM hits"
    )


def manifest_sql() -> str:
    tables = commas(f"({quote(t)})" for t in TABLES)
    both = "dataset NOT IN ('labels', 'pages')"
    flags = {
        "manifest_raw_text": "dataset = 'orders'",
        "manifest_error": "dataset = 'events'",
        "file_missing": "dataset = 'pages'",
        "file_unlisted": "dataset = 'labels'",
        "size": f"dataset = 'region' AND {both}",
        "sha256": f"dataset = 'part' AND {both}",
        "rows": f"dataset = 'nation' AND {both}",
    }
    return union(
        f"SELECT dataset, {quote(check)} AS \"check\", CAST({flag} AS BIGINT) AS n_bad "
        f"FROM (VALUES {tables}) AS v(dataset)"
        for check, flag in flags.items()
    )


# --- text -------------------------------------------------------------------

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(source: str, key: str, text: str) -> str:
    return (
        f"SELECT {key}, unnest(generate_series(1, len(parts))) AS line_number, "
        f"unnest(parts) AS line FROM (SELECT {key}, CASE WHEN parts[-1] = '' THEN parts[:-2] "
        f"ELSE parts END AS parts FROM (SELECT {key}, "
        f"regexp_split_to_array({text}, {quote(LINE_BREAK)}) AS parts FROM {source}))"
    )


def planted_text(key: str, text: str) -> str:
    whens = " ".join(
        f"WHEN {key} % 50 = {i} THEN concat({text}, chr(10), {quote(line)})"
        for i, line in enumerate(PLANTED_LINES)
    )
    return f"CASE {whens} ELSE {text} END"


def scan_sql(source: str, key: str, text: str) -> str:
    def rule(p: Pattern) -> str:
        if p.regex:
            return f"regexp_matches(line, {quote(p.text)})"
        return f"contains(lower(line), {quote(p.text.lower())})"

    hits = union(
        f"SELECT {key}, CAST(line_number AS INTEGER) AS line_number, {quote(p.label)} AS pattern FROM lines WHERE {rule(p)}"
        for p in SCAN_PATTERNS
    )
    return query({"lines": lines_sql(source, key, text)}, hits)


WORDS = "list_filter(regexp_split_to_array(lower({0}), '[ \\n.,]+'), lambda w: w <> '')"


def ids_sql(text: str) -> str:
    words = WORDS.format(text)
    return (
        f"list_transform({words}, lambda w: CAST(('0x' || substr(md5(w), 1, 7)) AS INTEGER))"
    )


def turns_from(later: int, role: str = "") -> str:
    """Messages named by the turn ``later`` turns before them."""
    mine = f" AND role = '{role}'" if role else ""
    total = f"(CAST(conv_id AS BIGINT) + turn - {later})"
    paired = f"{total} * ({total} + 1) // 2 + turn - {later}"
    return (
        f"SELECT {paired} AS conv_id, role, text "
        f"FROM conversations WHERE turn >= {later}{mine}"
    )


TURNS = (
    "SELECT conv_id, p.text AS prompt, c.text AS chosen, r.text AS rejected "
    f"FROM ({turns_from(0, 'user')}) p LEFT JOIN ({turns_from(1, 'assistant')}) c USING (conv_id) "
    f"LEFT JOIN ({turns_from(3, 'assistant')}) r USING (conv_id)"
)
PAIRS = (
    f"SELECT * FROM ({TURNS}) WHERE prompt IS NOT NULL AND chosen IS NOT NULL "
    "AND rejected IS NOT NULL"
)
MESSAGES = {
    "t0": turns_from(0),
    "t1": turns_from(1),
    "t3": turns_from(3),
    "msg": "SELECT conv_id, t0.role AS r0, t0.text AS x0, t1.role AS r1, t1.text AS x1, "
    "t3.role AS r3, t3.text AS x3 FROM t0 "
    "LEFT JOIN t1 USING (conv_id) LEFT JOIN t3 USING (conv_id)",
    "chk": "SELECT *, CASE WHEN r0 IS NULL OR r1 IS NULL OR r3 IS NULL THEN 'message_count' "
    "WHEN r0 <> 'user' OR r1 <> 'assistant' OR r3 <> 'assistant' THEN 'roles' "
    "WHEN coalesce(x0, '') = '' THEN 'empty_prompt' "
    "WHEN coalesce(x1, '') = '' THEN 'empty_chosen' "
    "WHEN coalesce(x3, '') = '' THEN 'empty_rejected' END AS reason FROM msg",
}


def encoded(limit: int = MAX_TOKENS, spoil: bool = True, source: str = TURNS) -> dict[str, str]:
    full = "head || response || " + quote(EOS) + " || chr(10)"
    if spoil:
        full = (
            f"CASE WHEN conv_id % 7 = 0 THEN 'X' || {full} "
            f"WHEN conv_id % 7 = 1 THEN head || response ELSE {full} END"
        )
    return {
        "turns": source,
        "sides": "SELECT conv_id, 'chosen' AS side, coalesce(prompt, '') AS prompt, "
        "coalesce(chosen, '') AS response FROM turns UNION ALL "
        "SELECT conv_id, 'rejected', coalesce(prompt, ''), coalesce(rejected, '') FROM turns",
        "heads": "SELECT *, 'USER:' || prompt || chr(10) || 'ASSISTANT:' AS head FROM sides",
        "fulls": f"SELECT *, {full} AS whole FROM heads",
        "trimmed": "SELECT *, rtrim(whole, chr(10)) AS body FROM fulls",
        "texts": f"SELECT *, CASE WHEN ends_with(body, {quote(EOS)}) THEN body "
        f"ELSE body || {quote(' ' + EOS)} END AS full_text FROM trimmed",
        "toks": f"SELECT *, {ids_sql('head')} AS pids, {ids_sql('full_text')} AS ids FROM texts",
        "enc": "SELECT conv_id, side, full_text, len(pids) AS prompt_length, "
        "len(ids) - len(pids) AS response_length, "
        f"CASE WHEN len(ids) > 0 THEN list_append(ids[:-2], {EOS_ID}) ELSE ids END AS input_ids, "
        "CASE WHEN NOT starts_with(whole, head) THEN 'prompt_prefix' "
        "WHEN len(ids) = 0 THEN 'no_tokens' "
        f"WHEN len(pids) >= {limit} - 2 THEN 'prompt_too_long' "
        f"WHEN len(ids) > {limit} THEN 'sequence_too_long' "
        "WHEN len(ids) <= len(pids) THEN 'empty_response' END AS reason FROM toks",
    }


def token_counts() -> dict[str, str]:
    return {
        "tok": f"SELECT lang, unnest({WORDS.format('text')}) AS token FROM documents",
        "tt": "SELECT token, count(*) AS base, "
        + commas(f"count(*) FILTER (lang = {quote(m)}) AS {m}" for m in LANGS)
        + " FROM tok GROUP BY 1",
    }


def pair_totals() -> dict[str, str]:
    models = ("base", *LANGS)
    long = union(
        f"SELECT {quote(m)} AS model, token, {m} AS n FROM tt WHERE {m} > 0" for m in models
    )
    return {
        **token_counts(),
        "counts": long,
        "size": "SELECT model, sum(n) AS total, count(*) AS vocab FROM counts GROUP BY 1",
        "pr": PAIRS,
        "words": f"SELECT conv_id, 'chosen' AS side, unnest({WORDS.format('chosen')}) AS token FROM pr "
        f"UNION ALL SELECT conv_id, 'rejected', unnest({WORDS.format('rejected')}) FROM pr",
        "tot": "SELECT conv_id, side, size.model AS model, count(*) AS tokens, "
        "sum(ln((coalesce(n, 0) + 1) / CAST(total + vocab + 1 AS DOUBLE))) AS logprob "
        "FROM words CROSS JOIN size LEFT JOIN counts "
        "ON counts.model = size.model AND counts.token = words.token GROUP BY 1, 2, 3",
    }


# --- selection --------------------------------------------------------------

SELECTABLE = {
    "s": score_rows_sql(f"{ROW_ID} AS row_id"),
    "rows_": "SELECT dataset_trait, row_id, prompt_hash, chosen_response_tokens, rejected_response_tokens, "
    f"{formula_sql('sum', 't0')} AS score FROM s",
    "ord": "SELECT *, row_number() OVER (PARTITION BY dataset_trait ORDER BY score DESC, "
    f"{digest('row_id')}, row_id) AS position, "
    "count(*) OVER (PARTITION BY dataset_trait) AS group_rows FROM rows_",
    "sel": "SELECT * FROM ord WHERE position <= ceil(group_rows * CAST(0.1 AS DOUBLE))",
}


def repeatability_sql() -> str:
    pooled = "SELECT a AS v FROM runs UNION ALL SELECT b FROM runs"
    first = union(
        f"SELECT row_id, {quote(a)} AS trait, {formula_sql('sum', a)} AS a FROM s" for a in TRAITS
    )
    noise = f"(({uniform('row_id', 'trait')} % 5) - 2) / CAST(64 AS DOUBLE)"

    def position(x: str) -> str:
        return (
            f"row_number() OVER (PARTITION BY trait ORDER BY {x} DESC, "
            "md5(concat_ws('|', row_id, trait)), row_id)"
        )

    ctes = {
        "s": score_rows_sql(f"{ROW_ID} AS row_id"),
        "first_": first,
        "runs": f"SELECT *, a + {noise} AS b FROM first_",
        "mean_": "SELECT trait, avg(a) AS a, avg(b) AS b FROM runs GROUP BY 1",
        "mrank": ranked("(SELECT 0 AS k, * FROM mean_)", "k", ("a", "b")),
        "iqr": f"SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS q FROM ({pooled})",
        "tops": "SELECT (SELECT list_sort(list(trait)) FROM (SELECT trait FROM mean_ "
        "ORDER BY a DESC, trait LIMIT 3)) = (SELECT list_sort(list(trait)) FROM "
        "(SELECT trait FROM mean_ ORDER BY b DESC, trait LIMIT 3)) AS same",
        "gap": "SELECT max(abs(a - b)) AS g FROM mean_",
        "rk": ranked("runs", "trait", ("a", "b")),
        "pos": f"SELECT trait, row_id, {position('a')} AS pa, {position('b')} AS pb, "
        "count(*) OVER (PARTITION BY trait) AS n FROM runs",
    }
    gates = [
        "SELECT 'trait_mean_spearman' AS gate, '' AS trait, corr(a, b) AS value, corr(a, b) >= 0.9 AS passed FROM mrank",
        "SELECT 'top_traits_equal', '', CAST(same AS DOUBLE), same FROM tops",
        "SELECT 'max_mean_difference', '', g, g <= q * CAST(0.1 AS DOUBLE) FROM gap, iqr",
        "SELECT 'share_of_pooled_iqr', '', g / q, g / q <= CAST(0.1 AS DOUBLE) FROM gap, iqr",
        "SELECT 'allowed_mean_difference', '', q * CAST(0.1 AS DOUBLE), NULL FROM iqr",
        "SELECT 'row_spearman', trait, corr(a, b), corr(a, b) >= 0.9 FROM rk GROUP BY trait",
    ]
    size = "ceil(n / CAST(10 AS DOUBLE))"
    for side, rule in (("top", "{0} <= " + size), ("bottom", "{0} > n - " + size)):
        hit = f"({rule.format('pa')}) AND ({rule.format('pb')})"
        share = f"count(*) FILTER ({hit}) / max({size})"
        gates.append(f"SELECT '{side}_decile_overlap', trait, {share}, {share} >= 0.5 FROM pos GROUP BY trait")
    body = union(gates)
    return query(ctes, f"SELECT gate, trait, {r('value', 6, 'value')}, passed FROM ({body})")


def study_sql() -> str:
    boot = replicate_r(multinomial(REPLICATES, ["sum"], ["row"]))
    boot["bcal"] = boot.pop("cal")
    boot["br"] = boot.pop("br").replace("FROM cal ", "FROM bcal ")
    ctes = {
        **cube(),
        **{k: v for k, v in boot.items() if k not in ("s", "d", "g", "target")},
        "base_": "SELECT formula, c, t, value FROM cube WHERE weighting = 'row'",
        **calibrated("all", "(SELECT *, 'x' AS x FROM base_ WHERE formula = 'sum')", "formula", "cal"),
        "prim": "SELECT c, t, z AS value FROM cal",
        "target": TARGET,
        "al": "SELECT c, t, value AS s, e FROM prim JOIN target USING (c, t)",
        "offd": "SELECT 0 AS k, * FROM al WHERE c <> t",
        "offr": ranked("offd", "k"),
        "colr": ranked("offd", "t"),
        "rawsum": "SELECT c, t, value AS s, e FROM base_ JOIN target USING (c, t) "
        "WHERE formula = 'sum' AND c <> t",
        "rawsep": "SELECT c, t, value AS s, e FROM base_ JOIN target USING (c, t) "
        "WHERE formula = 'separate' AND c <> t",
        "rawsepr": ranked("rawsep", "t"),
        **permutations(DRAWS),
        "null_r": NULL_DRAWS,
        "obs": OBSERVED,
        "pv": PVALUES,
        "iv": INTERVAL,
    }
    # Dependencies first: the bootstrap's target and groups come from this list.
    order = ["s", "d", "g", "m", "cube", "target"]
    ctes = {**{k: ctes[k] for k in order}, **{k: v for k, v in ctes.items() if k not in order}}

    def rank_of(source: str) -> str:
        return (
            "SELECT c, row_number() OVER (ORDER BY s DESC, c) AS k "
            f"FROM {source} WHERE c <> t AND t = {quote(COLUMN)}"
        )

    metrics = [
        "SELECT 'combined_pearson' AS metric, corr(s, e) AS value FROM offd",
        "SELECT 'combined_spearman', corr(s, e) FROM offr",
        f"SELECT 'column_pearson', corr(s, e) FROM offd WHERE t = {quote(COLUMN)}",
        f"SELECT 'column_spearman', corr(s, e) FROM colr WHERE t = {quote(COLUMN)}",
        f"SELECT 'column_raw_separate_spearman', corr(s, e) FROM rawsepr WHERE t = {quote(COLUMN)}",
        f"SELECT 'column_raw_sum_pearson', corr(s, e) FROM rawsum WHERE t = {quote(COLUMN)}",
        f"SELECT 'column_rank', k FROM ({rank_of('al')}) WHERE c = {quote(NAMED)}",
        f"SELECT 'column_raw_rank', k FROM ({rank_of('rawsep')}) WHERE c = {quote(NAMED)}",
        f"SELECT 'column_rows', sum(n) FROM g WHERE dataset_trait = {quote(COLUMN)}",
        f"SELECT 'column_prompt_groups', count(*) FROM g WHERE dataset_trait = {quote(COLUMN)}",
        "SELECT 'bootstrap_low', low FROM iv",
        "SELECT 'bootstrap_high', high FROM iv",
        "SELECT 'permutation_one_sided_p', p_one_sided FROM pv",
        "SELECT 'permutation_two_sided_p', p_two_sided FROM pv",
    ]
    body = union(metrics)
    return query(ctes, f"SELECT metric, round(CAST(value AS DOUBLE), 8) AS value FROM ({body})")


def with_models_sql() -> str:
    ctes = encoded(1 << 20, False, PAIRS)

    def total(weight: int) -> str:
        # Zero-based position p of a 1-based list index i is i - 1.
        return (
            "list_sum(list_transform(range(prompt_length + 1, len(input_ids) + 1), "
            f"lambda i: -((input_ids[i]::BIGINT * {weight} + (i - 1)) % 13 + 1) / CAST(8 AS DOUBLE)))"
        )

    ctes["lp"] = f"SELECT *, {total(1)} AS base, {total(3)} AS a1 FROM enc WHERE reason IS NULL"
    ctes["paired"] = (
        "SELECT c.conv_id, c.prompt_length AS prompt_tokens, "
        "c.response_length AS chosen_response_tokens, r.response_length AS rejected_response_tokens, "
        "c.base AS base_chosen_logprob, r.base AS base_rejected_logprob, "
        "c.a1 AS a1_chosen_logprob, r.a1 AS a1_rejected_logprob FROM lp c JOIN lp r "
        "ON r.conv_id = c.conv_id AND c.side = 'chosen' AND r.side = 'rejected'"
    )
    deltas = commas(f"{formula_sql(f, 'a1')} AS {delta_column(f, 'a1')}" for f in FORMULAS)
    return query(
        ctes,
        "SELECT conv_id AS row_id, sha256(prompt) AS prompt_hash, sha256(chosen) AS chosen_hash, "
        f"sha256(rejected) AS rejected_hash, paired.* EXCLUDE (conv_id), {deltas} "
        "FROM paired JOIN turns USING (conv_id)",
    )


def wide_pairs_sql() -> str:
    models = ("base", *LANGS)
    columns = commas(
        f"max(CASE WHEN model = {quote(m)} AND side = '{side}' THEN logprob END) "
        f"AS {m}_{side}_logprob"
        for m in models
        for side in ("chosen", "rejected")
    )
    ctes = {
        **pair_totals(),
        "w": "SELECT conv_id, max(tokens) FILTER (side = 'chosen') AS chosen_response_tokens, "
        "max(tokens) FILTER (side = 'rejected') AS rejected_response_tokens, "
        f"{columns} FROM tot GROUP BY 1",
    }
    numbers = [f"{m}_{side}_logprob" for m in models for side in ("chosen", "rejected")]
    deltas = [(formula_sql(f, a), delta_column(f, a)) for f in FORMULAS for a in LANGS]
    selected = [r(n, 6, n) for n in numbers] + [r(x, 6, n) for x, n in deltas]
    return query(
        ctes,
        "SELECT conv_id, chosen_response_tokens, rejected_response_tokens, "
        f"{commas(selected)} FROM w",
    )


def oracle_sql() -> dict[str, str]:
    long_rows = union(
        f"SELECT dataset_trait, row_key, {quote(f)} AS formula, {quote(a)} AS adapter, "
        f"{delta_column(f, a)} AS score FROM d"
        for f in FORMULAS
        for a in TRAITS
    )
    keep = "dataset_trait, row_key"
    deltas = {"s": score_rows_sql(), "d": with_deltas(FORMULAS, keep)}
    sums = commas(r(f"sum_{f}_{a}", 6, f"sum_{f}_{a}") for f in FORMULAS for a in TRAITS)
    cells = f"SELECT formula, weighting, c, t, {r('value', 9, 'value')} FROM cube"
    both = {
        **cube(),
        **calibrated("all"),
        **calibrated("leave_one_dataset_out", name="loo"),
        "target": TARGET,
    }

    def numbers(digits: int, source: str) -> str:
        names = commas(r(n, digits, n) for n in ("mean", "population_sd", "z"))
        names = f"{r('value', 9, 'value')}, {names}"
        return f"SELECT formula, weighting, c, t, scheme, {names} FROM {source}"

    raw = {
        **cube(),
        "target": TARGET,
        "x": "SELECT formula, weighting, c, t, value AS s, e FROM cube "
        "JOIN target USING (c, t) WHERE c <> t",
    }
    col = {
        **cube(),
        **calibrated("all"),
        "target": TARGET,
        "x": "SELECT formula, weighting, c, t, z AS s, e FROM cal "
        "JOIN target USING (c, t) WHERE c <> t",
    }
    pivot = commas(
        r(f"max(CASE WHEN t = {quote(t)} THEN z END)", 8, t) for t in TRAITS
    )
    by_variant = "SELECT formula, weighting, count(*) AS cells, round(corr(s, e), 9) AS r"
    by_column = "SELECT formula, weighting, t, count(*) AS cells, round(corr(s, e), 8) AS r"
    family = union(
        [
            "SELECT 'raw' AS kind, formula, weighting, 'none' AS scheme, c, t, value FROM cube",
            "SELECT 'calibrated', formula, weighting, scheme, c, t, z FROM cal",
            "SELECT 'calibrated', formula, weighting, scheme, c, t, z FROM loo",
        ]
    )
    boot_cells = (
        f"SELECT replicate, formula, weighting, c, t, {r('value + CAST(3e-10 AS DOUBLE)', 9, 'value')} FROM boot"
    )
    rounded_interval = (
        f"SELECT formula, weighting, replicates, {r('low', 8, 'low')}, {r('high', 8, 'high')} "
        f"FROM ({INTERVAL})"
    )
    scan_documents = scan_sql(
        f"(SELECT doc_id, {planted_text('doc_id', 'text')} AS text FROM documents)", "doc_id", "text"
    )
    count_rows = (
        "SELECT dataset_trait AS name, sha256(concat_ws('|', dataset_trait, CAST(count(*) AS VARCHAR), "
        "CAST(CAST(-sum(base_chosen_logprob) AS BIGINT) AS VARCHAR))) AS digest FROM s GROUP BY 1"
    )
    engine_rows = union(
        f"SELECT row_id, {quote(m)} AS model, '{side}' AS side, {side}_response_tokens AS tokens, "
        f"{m}_{side}_logprob AS logprob FROM s"
        for m in ("base", "t0", "t1")
        for side in ("chosen", "rejected")
    )
    noise = f"(({uniform('row_id', 'model', 'side')} % 9) - 4) / CAST(256 AS DOUBLE)"
    table_rows = union(
        f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS rows, "
        f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::INTEGER "
        "AS columns"
        for t in TABLES
    )
    candidate_maps = (
        "SELECT *, conv_id % 11 AS k, list_transform(range(prompt_length + 1, len(input_ids) + 1), "
        "lambda i: -((input_ids[i]::BIGINT + (i - 1)) % 13 + 1) / CAST(8 AS DOUBLE)) AS lp "
        "FROM enc WHERE reason IS NULL"
    )
    misaligned = (
        "SELECT conv_id, side, CASE WHEN k = 5 THEN 'misaligned' WHEN k = 3 THEN 'missing_token' "
        "WHEN k = 4 THEN 'nonfinite' END AS reason, "
        "CASE WHEN k NOT IN (3, 4, 5) THEN list_sum(lp) END AS logprob FROM lpm"
    )
    bundle_errors = (
        "CASE dataset_trait WHEN 't3' THEN 'source_revision' WHEN 't7' THEN 'roundtrip:delta_sum_t0' "
        "ELSE '' END"
    )
    bucket = "(chosen_response_tokens + rejected_response_tokens) // 2"
    return {
        "flagship": query(
            PRIMARY, "SELECT count(*) AS cells, round(corr(s, e), 9) AS r FROM al WHERE c <> t"
        ),
        "score_rows": query(deltas, "SELECT * FROM d"),
        "scores_long": query(deltas, long_rows),
        "group_stats": query(groups(), f"SELECT dataset_trait, prompt_hash, n, {sums} FROM g"),
        "cube_row_mean": query(cube(weightings=["row"]), cells),
        "cube_prompt_mean": query(cube(weightings=["prompt"]), cells),
        "score_cube": query(cube(), cells),
        "calibrate_all": query({**cube(), **calibrated("all")}, numbers(8, "cal")),
        "calibrate_loo": query(
            {**cube(), **calibrated("leave_one_dataset_out")}, numbers(6, "cal")
        ),
        "calibration_params": query(
            {**cube(), **calibrated("all")},
            f"SELECT formula, weighting, c, {r('max(mean)', 8, 'mean')}, "
            f"{r('max(population_sd)', 8, 'population_sd')} FROM cal GROUP BY 1, 2, 3",
        ),
        "calibration_params_loo": query(
            {**cube(), **calibrated("leave_one_dataset_out")},
            f"SELECT formula, weighting, c, t, {r('mean', 6, 'mean')}, "
            f"{r('population_sd', 6, 'population_sd')} FROM cal",
        ),
        "matrix_pivot": query(
            {**cube(), **calibrated("all")},
            f"SELECT formula, weighting, c AS adapter_trait, {pivot} FROM cal GROUP BY 1, 2, 3",
        ),
        "matrix_text": f"SELECT c, t, printf('%.12g', e / 8) AS text FROM ({TARGET})",
        "matrix_files": query(
            both,
            f"SELECT kind, formula, weighting, scheme, c, t, {r('value', 8, 'value')} FROM ({family})",
        ),
        "align": query(PRIMARY, f"SELECT c, t, {r('s', 8, 's')}, {r('e', 8, 'e')} FROM al"),
        "off_diagonal": query(
            PRIMARY, f"SELECT c, t, {r('s', 8, 's')}, {r('e', 8, 'e')} FROM al WHERE c <> t"
        ),
        "assoc_pearson": query(raw, f"{by_variant} FROM x GROUP BY 1, 2"),
        "assoc_spearman": query(
            {**raw, "y": ranked("x", "formula, weighting")}, f"{by_variant} FROM y GROUP BY 1, 2"
        ),
        "column_assoc": query(col, f"{by_column} FROM x GROUP BY 1, 2, 3"),
        "column_assoc_spearman": query(
            {**col, "y": ranked("x", "formula, weighting, t")}, f"{by_column} FROM y GROUP BY 1, 2, 3"
        ),
        "predicted_rank": query(
            PRIMARY,
            f"SELECT t, c, {r('value', 8, 'value')}, CAST(row_number() OVER "
            "(PARTITION BY t ORDER BY value DESC, c) AS INTEGER) AS predicted_rank "
            "FROM prim WHERE c <> t",
        ),
        "sensitivity_grid": query(
            both,
            "SELECT formula, weighting, scheme, count(*) AS cells, round(corr(z, e), 8) AS r FROM "
            "(SELECT * FROM cal UNION ALL SELECT * FROM loo) JOIN target USING (c, t) "
            "WHERE c <> t GROUP BY 1, 2, 3",
        ),
        "bootstrap_multinomial": query(multinomial(REPLICATES, FORMULAS, WEIGHTINGS), boot_cells),
        "bootstrap_split": query(split_multinomial(REPLICATES, FORMULAS, WEIGHTINGS), boot_cells),
        "bootstrap_poisson": query(poisson(REPLICATES, FORMULAS, WEIGHTINGS), boot_cells),
        "bootstrap_associations": query(
            replicate_r(multinomial(REPLICATES, FORMULAS, WEIGHTINGS)),
            f"SELECT replicate, formula, weighting, cells, {r('r', 8, 'r')} FROM br",
        ),
        "bootstrap_interval": query(
            replicate_r(multinomial(REPLICATES, ["sum"], ["row"])), rounded_interval
        ),
        "bootstrap_interval_poisson": query(
            replicate_r(poisson(REPLICATES, ["sum"], ["row"])), rounded_interval
        ),
        "perm_draws": query(
            {**permutations(DRAWS), "target": TARGET},
            "SELECT draw, perm.c AS c, source, total FROM perm JOIN "
            "(SELECT c AS source, sum(e) AS total FROM target GROUP BY 1) USING (source)",
        ),
        "perm_null": query(
            {**PRIMARY, **permutations(DRAWS)},
            f"SELECT draw, {r('r', 9, 'r')} FROM ({NULL_DRAWS})",
        ),
        "perm_pvalue": query(
            {**PRIMARY, **permutations(DRAWS), "null_r": NULL_DRAWS, "obs": OBSERVED},
            f"SELECT {r('observed', 9, 'observed')}, draws, {r('p_one_sided', 9, 'p_one_sided')}, "
            f"{r('p_two_sided', 9, 'p_two_sided')} FROM ({PVALUES})",
        ),
        "headline_study": study_sql(),
        "reproduction_gates": gates_sql(),
        "dq_columns": columns_sql(),
        "dq_identity": checks_sql("dataset_name", "source_revision"),
        "dq_hashes": checks_sql("hash"),
        "dq_lengths": checks_sql("length"),
        "dq_finite": checks_sql("finite"),
        "dq_roundtrip": checks_sql("roundtrip", errors=True),
        "dq_unique": query(
            {"s": score_rows_sql()},
            "SELECT dataset_trait AS dataset, 'unique_row_id' AS \"check\", "
            "count(*) - count(DISTINCT row_key) AS n_bad FROM s GROUP BY 1",
        ),
        "dq_unique_offenders": query(
            {"s": score_rows_sql()},
            "SELECT dataset_trait AS dataset, row_key AS row_id, count(*) AS copies "
            "FROM s GROUP BY 1, 2 HAVING count(*) > 1",
        ),
        "dq_row_counts": query(
            {"s": score_rows_sql()},
            "SELECT dataset_trait AS dataset, count(*) AS rows, CAST(0 AS BIGINT) AS n_bad "
            "FROM s GROUP BY 1 UNION ALL SELECT 'absent', 0, 1",
        ),
        "dq_report": report_sql(),
        "dq_manifest": manifest_sql(),
        "dq_bundle": query(
            {"s": score_rows_sql()},
            f"SELECT dataset_trait AS dataset, count(*) AS rows, {bundle_errors} = '' AS passed, "
            f"CAST({bundle_errors} <> '' AS BIGINT) AS failed_checks, {bundle_errors} AS errors, "
            "CASE WHEN dataset_trait = 't7' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            "AS max_error FROM s GROUP BY dataset_trait",
        ),
        "dq_bundle_totals": query(
            {"s": score_rows_sql()},
            "SELECT false AS passed, count(DISTINCT dataset_trait) AS datasets_validated, count(*) AS total_rows, "
            "CAST(0 AS DOUBLE) AS max_error, true AS schema_identical, "
            "(SELECT count(*) FROM orders WHERE o_orderkey % 500 = 0) AS text_findings "
            "FROM s WHERE dataset_trait NOT IN ('t3', 't7')",
        ),
        "dq_file_schemas": query(
            {"s": f"SELECT DISTINCT dataset_trait AS dataset FROM ({score_rows_sql()})"},
            "SELECT dataset, 'schema_differs' AS \"check\", dataset = 't6' AS failed FROM s "
            "UNION ALL SELECT dataset, 'hidden_raw_text', dataset IN ('t2', 't4') FROM s",
        ),
        "source_file_digests": tree_digest_sql(),
        "source_dataset_digests": dataset_digest_sql(),
        "source_scores": query(
            deltas | {"s": score_rows_sql()},
            "SELECT dataset_trait AS file_dataset, dataset_trait, count(*) AS n, "
            f"sum(base_chosen_logprob) AS base_chosen, sum({formula_sql('sum', 't0')}) "
            "AS delta_sum_t0 FROM s GROUP BY dataset_trait",
        ),
        "source_pairs": query(
            MESSAGES,
            "SELECT CAST(conv_id AS VARCHAR) AS row_id, reason, "
            "CAST((r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT AS INTEGER) AS chosen_messages, "
            "CAST((r0 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT AS INTEGER) AS rejected_messages "
            "FROM chk",
        ),
        "source_footers": table_rows,
        "source_text_lines": query(
            {"lines": lines_sql("documents", "doc_id", "text")},
            "SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, sha256(line) AS line_hash "
            "FROM lines",
        ),
        "source_manifest": query(
            {"s": score_rows_sql()},
            "SELECT dataset_trait AS dataset, count(*) AS rows, count(*) * 8 AS size_bytes, "
            "sha256(dataset_trait) AS sha256, false AS contains_raw_text, "
            "CAST(0 AS DOUBLE) AS formula_round_trip_max_abs_error FROM s GROUP BY dataset_trait",
        ),
        "sink_report": query(
            {**cube(["sum"], ["row"]), **calibrated("all")},
            f"SELECT formula, weighting, c, {r('max(mean)', 8, 'mean')}, "
            f"{r('max(population_sd)', 8, 'population_sd')} FROM cal GROUP BY 1, 2, 3",
        ),
        "text_hashes": "SELECT conv_id, turn, sha256(text) AS hash FROM conversations",
        "pairs_valid": query(
            MESSAGES,
            "SELECT conv_id, sha256(x0) AS prompt_hash, sha256(x1) AS chosen_hash, "
            "sha256(x3) AS rejected_hash FROM chk WHERE reason IS NULL",
        ),
        "pairs_rejected": query(
            MESSAGES, "SELECT conv_id, reason FROM chk WHERE reason IS NOT NULL"
        ),
        "encode_boundary": query(
            encoded(),
            "SELECT conv_id, side, md5(full_text) AS text_hash, "
            "md5(array_to_string(input_ids, ',')) AS ids_hash, "
            "CAST(prompt_length AS INTEGER) AS prompt_length, "
            "CAST(response_length AS INTEGER) AS response_length, reason FROM enc",
        ),
        "response_logprob": query({**encoded(), "lpm": candidate_maps}, misaligned),
        "token_table": query(token_counts(), "SELECT * FROM tt"),
        "score_pairs": query(
            pair_totals(),
            f"SELECT conv_id, side, model, tokens, {r('logprob', 6, 'logprob')} FROM tot",
        ),
        "scores_wide": wide_pairs_sql(),
        "score_with_models": with_models_sql(),
        "scan_text": scan_documents,
        "scan_text_counts": "SELECT pattern, count(*) AS findings, count(DISTINCT doc_id) AS texts "
        f"FROM ({scan_documents}) GROUP BY 1",
        "scan_pages": scan_sql("pages", "page_id", "html"),
        "scan_file_list": union(
            f"SELECT '{t}.parquet' AS name, '{p}' AS pattern"
            for t in TABLES
            for p in ("oversize_file", "model_binary")
        ),
        "reconcile_digests": query(
            {"s": score_rows_sql(), "o": count_rows},
            "SELECT name, CASE WHEN name = 't3' THEN upper(digest) ELSE digest END AS expected, "
            "CASE WHEN name <> 't5' THEN digest END AS observed FROM o WHERE name IN ('t3', 't5')",
        ),
        "target_checks": query(
            {
                **raw,
                "v": "SELECT formula || '/' || weighting AS metric, corr(s, e) AS value "
                "FROM x GROUP BY 1",
            },
            "SELECT metric, CASE WHEN metric <> 'lls/row' THEN round(value, 9) END AS value, "
            "round(value, 2) AS target, CAST(0.0025 AS DOUBLE) AS tolerance, "
            "metric <> 'lls/row' AND abs(value - round(value, 2)) <= 0.0025 AS passed FROM v",
        ),
        "sentinel_checks": query(
            {"target": TARGET},
            "SELECT 't0' AS c, 't1' AS t, CAST(1 AS DOUBLE) AS expected, e AS value, "
            "abs(e - 1) <= 1e-12 AS passed FROM target WHERE c = 't0' AND t = 't1' "
            "UNION ALL SELECT 't0', 't2', e, e, true FROM target WHERE c = 't0' AND t = 't2' "
            "UNION ALL SELECT 'absent', 't1', 1, NULL, false",
        ),
        "select_by_score": query(
            SELECTABLE,
            "SELECT dataset_trait, row_id, score, 'top fraction 0.1 by score' AS rule FROM sel",
        ),
        "select_top_k": query(
            SELECTABLE, "SELECT dataset_trait, row_id, score FROM ord WHERE position <= 500"
        ),
        "select_threshold": query(
            SELECTABLE, "SELECT dataset_trait, row_id, score FROM rows_ WHERE score >= 2.5"
        ),
        "selection_manifest": query(
            SELECTABLE,
            "SELECT dataset_trait, sha256(row_id) AS row_hash, prompt_hash, 'top fraction 0.1 by score' AS rule FROM sel",
        ),
        "random_control": query(
            {
                **SELECTABLE,
                "q": "SELECT dataset_trait, count(*) AS n FROM sel GROUP BY 1",
                "h": "SELECT *, row_number() OVER (PARTITION BY dataset_trait ORDER BY "
                f"{digest('row_id')}, row_id) AS p FROM rows_",
            },
            "SELECT dataset_trait, row_id FROM h JOIN q USING (dataset_trait) WHERE p <= n",
        ),
        "length_control": query(
            {
                **SELECTABLE,
                "q": f"SELECT dataset_trait, {bucket} AS length_bucket, count(*) AS n "
                "FROM sel GROUP BY 1, 2",
                "h": f"SELECT *, {bucket} AS length_bucket, row_number() OVER (PARTITION BY "
                f"dataset_trait, {bucket} ORDER BY {digest('row_id')}, row_id) AS p FROM rows_ "
                "WHERE (dataset_trait, row_id) NOT IN (SELECT (dataset_trait, row_id) FROM sel)",
            },
            "SELECT dataset_trait, length_bucket, row_id FROM h "
            "JOIN q USING (dataset_trait, length_bucket) WHERE p <= n",
        ),
        "dataset_positions": query(
            {
                **SELECTABLE,
                "h": "SELECT *, row_number() OVER (PARTITION BY dataset_trait ORDER BY score DESC, "
                "md5(row_id), row_id) AS p FROM ord",
            },
            "SELECT dataset_trait, row_id, p AS position, group_rows FROM h",
        ),
        "repeatability": repeatability_sql(),
        "engine_agreement": query(
            {
                "s": score_rows_sql(f"{ROW_ID} AS row_id"),
                "e1": engine_rows,
                "e2": f"SELECT *, logprob + {noise} AS other FROM e1",
                "gap": "SELECT model, count(*) AS n, "
                "max(abs(logprob / tokens - other / tokens)) AS g FROM e2 GROUP BY 1",
            },
            f"SELECT model, n AS comparisons, {r('g', 9, 'max_abs_difference')}, "
            "g <= CAST(0.01 AS DOUBLE) AS passed FROM gap",
        ),
    }

