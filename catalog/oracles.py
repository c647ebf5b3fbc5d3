"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from catalog.sqlparts import (
    lit,
    normal,
    pick,
    position,
    profile_sql,
    source,
    stripped,
    uniform,
    whole,
)
from catalog.views import dirty_kinds, dirty_sql
from tabmend.functions import fixed
from tabmend.operators.synthesize import FIRST_NAMES, LAST_NAMES, STREETS, TOWNS

SEED = 42
DIRTY = f"({dirty_sql()})"
ALL = list(dirty_kinds())


def dirty_profile(select: str, **kwargs) -> str:
    return profile_sql("dirty", select, **kwargs)


def _in(names) -> str:
    return "(" + ", ".join(lit(n) for n in names) + ")"


SPEC_COLUMNS = (
    'ord, col AS "column", role, semantic AS semantic_type, low, high, minority_value, description'
)


def _rule(rule: str, *names: str) -> str:
    parts = [
        f"SELECT * FROM ({profile_sql(n, _RULE.format(table=n, rule=rule))})" for n in names
    ]
    return " UNION ALL ".join(parts)


_RULE = (
    "SELECT '{table}' AS \"table\", col AS \"column\", "
    "CASE WHEN rule = 'id' THEN 'id' WHEN rule IN ('ignore_text', 'nominal') THEN 'ignore' "
    "ELSE 'feature' END AS role, semantic AS semantic_type, description FROM spec WHERE rule = '{rule}'"
)

# spelling groups, per column, of a CTE vals(col, v)
ALIAS_STAGES = {
    "vals": "SELECT col, v FROM counts WHERE col IN ('country', 'market', 'segment')",
    "keyed": "SELECT col, v, lower(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g')) AS k FROM vals",
    "spelled": """SELECT *, count(*) OVER (PARTITION BY col, k) AS members,
        first_value(v) OVER (PARTITION BY col, k ORDER BY
          regexp_matches(v, '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]'), length(v) DESC, v) AS canonical
        FROM keyed WHERE k <> ''""",
    "pass1": "SELECT col, v AS alias, canonical FROM spelled WHERE members > 1 AND v <> canonical",
    "unspelled": """SELECT k.col, k.v FROM keyed k LEFT JOIN spelled s
        ON k.col = s.col AND k.v = s.v AND s.members > 1 WHERE s.v IS NULL""",
    "phrases": """SELECT col, v, upper(array_to_string([w[1] FOR w IN ws], '')) AS ini
        FROM (SELECT col, v, [w FOR w IN regexp_split_to_array(trim(v), '[\\s_\\-]+') IF w <> ''] AS ws
              FROM unspelled) WHERE len(ws) > 1""",
    "claims": """SELECT p.col, p.v AS canonical, u.v AS alias FROM phrases p JOIN unspelled u
        ON p.col = u.col AND p.v <> u.v AND (upper(trim(u.v)) = p.ini
           OR (length(p.ini) >= 2 AND starts_with(upper(trim(u.v)), p.ini)
               AND length(trim(u.v)) <= length(p.ini) + 1)
           OR starts_with(upper(trim(u.v)), p.ini || '_'))""",
    "pass2": """SELECT c.col, c.alias, min(c.canonical) AS canonical FROM claims c
        WHERE NOT EXISTS (SELECT 1 FROM claims e WHERE e.col = c.col AND e.alias = c.canonical
                          AND e.canonical < c.canonical)
        GROUP BY c.col, c.alias""",
    "aliased": "SELECT * FROM pass1 UNION ALL SELECT * FROM pass2",
}


def _cleaned() -> str:
    """The stripped view with its aliases replaced, as a SELECT."""
    kinds = dirty_kinds()
    items = ", ".join(
        f"coalesce(a_{c}.canonical, s.{c}) AS {c}" if c in ("country", "market", "segment") else f"s.{c}"
        for c in kinds
    )
    joins = " ".join(
        f"LEFT JOIN aliased a_{c} ON a_{c}.col = '{c}' AND a_{c}.alias = s.{c}"
        for c in ("country", "market", "segment")
    )
    return f"SELECT {items} FROM src s {joins}"


def _stat(column: str, stat: str, cte: str = "spec") -> str:
    return f"(SELECT {stat} FROM {cte} WHERE col = '{column}')"


def _mask(column: str, z: bool = True, low: str | None = None, high: str | None = None) -> str:
    low = low or _stat(column, "low")
    high = high or _stat(column, "high")
    parts = [f"{column} IS NULL", f"{column} < {low}", f"{column} > {high}"]
    if z:
        far = f"abs({column} - {_stat(column, 'mean')}) / nullif({_stat(column, 'sd')}, 0) > 3"
        parts.append(far)
    return f"({' OR '.join(parts)})"


def _median(column: str, rel: str = "src", cast: str = "DOUBLE") -> str:
    inner = f"SELECT quantile_cont(CAST({column} AS DOUBLE), 0.5) FROM {rel} WHERE NOT {_mask(column)}"
    value = f"({inner})"
    return f"CAST(trunc({value}) AS BIGINT)" if cast == "BIGINT" else value


def _imputed(column: str, cast: str = "DOUBLE", rel: str = "src") -> str:
    return f"CASE WHEN {_mask(column)} THEN {_median(column, rel, cast)} ELSE {column} END AS {column}"


def _mode(column: str) -> str:
    return f"(SELECT v FROM ranked WHERE col = '{column}' AND most = 1)"


def _gauss(column: str, key: str, low: str, high: str, whole_number: bool, rel: str = "src") -> str:
    ok = f"{column} BETWEEN {low} AND {high}"
    m = f"(SELECT avg({column}) FROM {rel} WHERE {ok})"
    s = f"(SELECT stddev_pop({column}) FROM {rel} WHERE {ok})"
    cut = f"least(greatest({normal(SEED, column, key)} * {s} + {m}, {low}), least({high}, {m} + 3 * {s}))"
    value = f"CAST(round_even({cut}, 0) AS BIGINT)" if whole_number else f"round_even({cut}, 2)"
    bad = f"({column} IS NULL OR {column} < {low} OR {column} > {high})"
    return f"CASE WHEN {bad} THEN {value} ELSE {column} END AS {column}"


# --- synthetic rows of the dirty view, target churn ---------------------------


def _drawn(column: str, seed: int, kind: str, digits: int | None = None) -> str:
    low = f"coalesce({_stat(column, 'low')}, {_stat(column, 'mn')})"
    high = f"coalesce({_stat(column, 'high')}, {_stat(column, 'mx')})"
    sd = f"coalesce(nullif({_stat(column, 'sd')}, 0), 1.0)"
    cut = f"least(greatest({normal(seed, column, 'i')} * {sd} + {_stat(column, 'mean')}, {low}), {high})"
    if kind == "integer":
        return f"CAST(trunc({cut}) AS BIGINT) AS {column}"
    return f"round({cut}, {digits or 2}) AS {column}"


def _chosen(column: str, seed: int) -> str:
    vals = f"(SELECT list(v ORDER BY num, v) FROM counts WHERE col = '{column}')"
    size = f"(SELECT count(*) FROM counts WHERE col = '{column}')"
    return f"list_extract({vals}, {position(seed, column, 'u', 'i', size)} + 1) AS {column}"


def _name(column: str, seed: int = SEED) -> str:
    first = pick(list(FIRST_NAMES), seed, column, "first", "i")
    last = pick(list(LAST_NAMES), seed, column, "last", "i")
    return f"concat({first}, ' ', {last}) AS {column}"


def _synthetic_items(seed: int = SEED) -> dict[str, str]:
    return {
        "customer_id": "concat('SYN_', CAST((SELECT nrows FROM balance) + 1000 + i AS VARCHAR)) AS customer_id",
        "name": _name("name", seed),
        "age": _drawn("age", seed, "integer"),
        "balance": _drawn("balance", seed, "float"),
        "sparse": _drawn("sparse", seed, "float"),
        "country": _chosen("country", seed),
        "market": _chosen("market", seed),
        "segment": _chosen("segment", seed),
        "nation_code": _drawn("nation_code", seed, "integer"),
        "churn": "1 AS churn",
    }


ROWS = "(SELECT unnest(range(needed)) AS i FROM balance)"


def _synthetic(columns=ALL, seed: int = SEED) -> str:
    items = _synthetic_items(seed)
    return dirty_profile(f"SELECT {', '.join(items[c] for c in columns)} FROM {ROWS}")


def _union() -> str:
    items = _synthetic_items()
    base = ", ".join(f"round({c}, 2) AS {c}" if c in ("balance", "sparse") else c for c in ALL)
    return f"SELECT {base} FROM src UNION ALL SELECT {', '.join(items[c] for c in ALL)} FROM {ROWS}"


# a small frame next to the target: needed rows only
_SMALL = f"""WITH src AS ({dirty_sql()}),
  balance AS (SELECT count(*) AS nrows,
     CAST(trunc((CAST(0.35 AS DOUBLE) * count(*) - count(*) FILTER (churn = 1)) / CAST(0.65 AS DOUBLE)) AS BIGINT) AS needed
     FROM src)"""
_SYN_ID = "concat('SYN_', CAST((SELECT nrows FROM balance) + 1000 + i AS VARCHAR)) AS customer_id"


def _weighted() -> str:
    u = uniform(SEED, "vip", "u", "i")
    return f"""{_SMALL}
    SELECT {_SYN_ID}, CASE WHEN {u} * CAST(c.total AS DOUBLE) < c.no THEN 'false' ELSE 'true' END AS vip,
           1 AS churn
    FROM {ROWS}, (SELECT count(*) AS total, count(*) FILTER (nation_code >= 5) AS no FROM src) c"""


def _pii() -> str:
    first, last = list(FIRST_NAMES), list(LAST_NAMES)
    email = (
        f"concat(lower({pick(first, SEED, 'email', 'first', 'i')}), '.', "
        f"lower({pick(last, SEED, 'email', 'last', 'i')}), "
        f"CAST({whole(SEED, 'email', 'number', 'i', 1, 999)} AS VARCHAR), '@example.com') AS email"
    )
    a = "home_address"
    address = (
        f"concat(CAST({whole(SEED, a, 'number', 'i', 1, 999)} AS VARCHAR), ' ', "
        f"{pick(list(STREETS), SEED, a, 'street', 'i')}, ', ', "
        f"{pick(list(TOWNS), SEED, a, 'town', 'i')}) AS {a}"
    )
    return (
        f"{_SMALL} SELECT {_SYN_ID}, {_name('name')}, {email}, {address}, "
        f"CAST(NULL AS VARCHAR) AS phone, 1 AS churn FROM {ROWS}"
    )


def _dirty_gen() -> str:
    k = "c_custkey"
    age, salary = uniform(SEED, "age", "u", k), uniform(SEED, "salary", "u", k)
    return f"""
    SELECT concat('CUST_', CAST({k} + 1000 AS VARCHAR)) AS customer_id,
      concat({pick(list(FIRST_NAMES), SEED, 'name', 'first', k)}, ' ',
             {pick(list(LAST_NAMES), SEED, 'name', 'last', k)}) AS name,
      CASE WHEN {age} < 0.05 THEN -{whole(SEED, 'age', 'negative', k, 1, 10)}
           WHEN {age} < 0.08 THEN {whole(SEED, 'age', 'huge', k, 150, 300)}
           WHEN {age} < 0.20 THEN NULL ELSE {whole(SEED, 'age', 'plain', k, 18, 70)} END AS age,
      CASE WHEN {salary} < 0.03 THEN {whole(SEED, 'salary', 'extreme', k, 5000000, 20000000)}
           WHEN {salary} < 0.10 THEN NULL
           ELSE {whole(SEED, 'salary', 'plain', k, 35000, 180000)} END AS salary,
      CASE WHEN {uniform(SEED, 'city', 'u', k)} > 0.15
           THEN {pick(list(fixed.DIRTY_CITIES), SEED, 'city', 'pick', k)} END AS city,
      {pick(list(fixed.DIRTY_COUNTRIES), SEED, 'country', 'pick', k)} AS country,
      CASE WHEN {uniform(SEED, 'churn', 'u', k)} < 0.08 THEN 1 ELSE 0 END AS churn
    FROM customer"""


def _samples() -> str:
    columns = ALL
    parts = [
        f"SELECT {ALL.index(c)} AS ord, '{c}' AS \"column\", (SELECT string_agg(v, ' | ' ORDER BY k, v) "
        f"FROM (SELECT customer_id AS k, CAST({c} AS VARCHAR) AS v FROM src WHERE {c} IS NOT NULL "
        f"ORDER BY k, v LIMIT 5)) AS samples"
        for c in columns
    ]
    return f"WITH src AS ({dirty_sql()}) " + " UNION ALL ".join(parts)


def _summary() -> str:
    columns = ALL
    samples = " UNION ALL ".join(
        f"SELECT '{c}' AS c, string_agg(v, ' | ' ORDER BY k, v) AS samples "
        f"FROM (SELECT customer_id AS k, CAST({c} AS VARCHAR) AS v FROM src WHERE {c} IS NOT NULL "
        f"ORDER BY k, v LIMIT 5)"
        for c in columns
    )
    return profile_sql(
        "dirty",
        'SELECT ord, col AS "column", nrows AS rows, nulls, n_unique, '
        "round(nulls / nrows * 100, 1) AS null_percent, coalesce(samples, '') AS samples, "
        "mn AS min, mx AS max, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std "
        "FROM stats LEFT JOIN firsts ON firsts.c = stats.col",
        extra={"firsts": samples},
        columns=columns,
    )


def _moments(name: str) -> str:
    return profile_sql(
        name,
        'SELECT ord, col AS "column", filled, mn AS min, mx AS max, round(mean, 4) AS mean, '
        "round(med, 4) AS median, round(sd, 4) AS std FROM stats WHERE kind IN ('integer', 'float')",
    )


ISSUE_COLUMNS = 'ord, "column", type, count, ratio, low, high, minority_value, message'

# supplied schemas in place of the inferred one
OVERRIDE_SPEC = """
SELECT s.*, CASE col WHEN 'customer_id' THEN 'id' WHEN 'name' THEN 'ignore' WHEN 'churn' THEN 'target'
                     ELSE 'feature' END AS role,
  CASE WHEN col IN ('country') THEN 'categorical' WHEN col = 'churn' THEN 'binary'
       WHEN col IN ('customer_id', 'name') THEN 'text' WHEN col IN ('age', 'balance') THEN 'numerical'
       ELSE 'none' END AS semantic,
  CASE col WHEN 'age' THEN 0.0 WHEN 'balance' THEN -999.5 END AS low,
  CASE col WHEN 'age' THEN 120.0 WHEN 'balance' THEN 9999.5 END AS high, col = 'churn' AS is_target
FROM stats s"""
NO_SPEC = """
SELECT s.*, 'feature' AS role, 'none' AS semantic, CAST(NULL AS DOUBLE) AS low,
       CAST(NULL AS DOUBLE) AS high, {target} AS is_target FROM stats s"""

DOMAINS_SPEC = """
SELECT s.*, CASE col WHEN 'l_orderkey' THEN 'id' ELSE 'feature' END AS role,
  CASE WHEN col IN ('l_quantity', 'l_discount', 'l_tax', 'l_orderkey') THEN 'numerical' ELSE 'none' END AS semantic,
  CAST(CASE col WHEN 'l_quantity' THEN 5 WHEN 'l_discount' THEN 0 WHEN 'l_tax' THEN 0.01 WHEN 'l_orderkey' THEN 0 END
       AS DOUBLE) AS low,
  CAST(CASE col WHEN 'l_quantity' THEN 45 WHEN 'l_discount' THEN 0.05 WHEN 'l_tax' THEN 0.08 WHEN 'l_orderkey' THEN 10 END
       AS DOUBLE) AS high,
  col = 'l_linenumber' AS is_target FROM stats s"""

# what is left after the remediation of ver_reprofile and ver_delta
_FIXED = f"""
SELECT customer_id, name, {_imputed('age', 'BIGINT')},
  CASE WHEN {_mask('balance')} THEN 4000.0 ELSE balance END AS balance,
  country, market, segment, nation_code, churn FROM src"""


def _after_stages() -> dict[str, str]:
    """CTEs of a second profile, over ``done``, under the first one's schema."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS col, CAST({c} AS DOUBLE) AS num FROM done"
        for i, (c, k) in enumerate(dirty_kinds().items())
        if k != "string" and c != "sparse"
    )
    return {
        "done": _FIXED,
        "cells2": cells,
        "stats2": """SELECT c.ord, c.col, count(*) AS nrows, count(*) - count(num) AS nulls,
            avg(num) AS mean, stddev_pop(num) AS sd FROM cells2 c GROUP BY c.ord, c.col""",
        "after": """SELECT t.ord, t.col, t.nrows, t.nulls, s.role, s.semantic,
            count(*) FILTER (s.semantic <> 'categorical' AND (c.num < s.low OR c.num > s.high)) AS oob,
            count(*) FILTER (s.semantic NOT IN ('binary', 'categorical')
                             AND abs(c.num - t.mean) / nullif(t.sd, 0) > 3) AS z
            FROM stats2 t JOIN cells2 c USING (ord) JOIN spec s ON s.ord = t.ord
            GROUP BY ALL""",
    }


def _pipe_apply() -> str:
    """Strip, aliases, median of age and balance, drop sparse, synthesize churn."""
    spec = {"spec_src": "SELECT * FROM src"}
    after = {
        "cleaned": _cleaned(),
        "imputed": f"""SELECT customer_id, name, {_imputed('age', 'BIGINT', 'cleaned')},
            {_imputed('balance', 'DOUBLE', 'cleaned')}, country, market, segment, nation_code, churn
            FROM cleaned""",
        "acells": " UNION ALL ".join(
            f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, "
            f"{'CAST(' + c + ' AS DOUBLE)' if k != 'string' else 'CAST(NULL AS DOUBLE)'} AS num FROM imputed"
            for c, k in dirty_kinds().items()
            if c not in ("name", "sparse")
        ),
        "astats": """SELECT a.col, avg(a.num) AS mean, stddev_pop(a.num) AS sd, min(a.num) AS mn,
            max(a.num) AS mx, any_value(s.low) AS low, any_value(s.high) AS high
            FROM acells a JOIN spec s ON s.col = a.col GROUP BY a.col""",
        "acounts": "SELECT col, v, num FROM acells WHERE v IS NOT NULL GROUP BY col, v, num",
    }

    def drawn(column: str, kind: str) -> str:
        return _drawn(column, SEED, kind).replace("FROM spec ", "FROM astats ")

    def chosen(column: str) -> str:
        return _chosen(column, SEED).replace("FROM counts ", "FROM acounts ")

    select = f"""SELECT customer_id, name, age, round(balance, 2) AS balance, country, market, segment,
        nation_code, churn FROM imputed
      UNION ALL
      SELECT {_SYN_ID}, {_name('name')}, {drawn('age', 'integer')}, {drawn('balance', 'float')}, {chosen('country')},
        {chosen('market')}, {chosen('segment')}, {drawn('nation_code', 'integer')}, 1 AS churn FROM {ROWS}"""
    return profile_sql("dirty", select, strip=True, extra={**ALIAS_STAGES, **spec, **after})


def _rem_chain() -> str:
    imputed = f"SELECT customer_id, {_imputed('age', 'BIGINT')}, balance, nation_code, churn FROM src"
    stages = {
        "step1": imputed,
        "ages": """SELECT 'age' AS col, avg(age) AS mean, stddev_pop(age) AS sd, min(age) AS mn,
            max(age) AS mx, (SELECT low FROM spec WHERE col = 'age') AS low,
            (SELECT high FROM spec WHERE col = 'age') AS high FROM step1""",
        "rows2": f"""SELECT customer_id, age, balance, nation_code, churn FROM step1 UNION ALL
            SELECT {_SYN_ID}, {_drawn('age', SEED, 'integer').replace('FROM spec ', 'FROM ages ')},
              {_drawn('balance', SEED, 'float', 15)}, {_drawn('nation_code', SEED, 'integer')}, 1 AS churn
            FROM {ROWS}""",
        "m2": "SELECT avg(balance) AS mean, stddev_pop(balance) AS sd FROM rows2",
        "bad2": """SELECT *, (balance IS NULL OR balance < (SELECT low FROM spec WHERE col = 'balance')
            OR balance > (SELECT high FROM spec WHERE col = 'balance')
            OR abs(balance - (SELECT mean FROM m2)) / (SELECT sd FROM m2) > 3) AS bad FROM rows2""",
    }
    return profile_sql(
        "dirty",
        """SELECT customer_id, age, round(CASE WHEN bad THEN (SELECT quantile_cont(balance, 0.5)
             FROM bad2 WHERE NOT bad) ELSE balance END, 2) AS balance, nation_code, churn FROM bad2""",
        extra=stages,
    )


def _man_actions(strategy: str, strip: bool = False) -> str:
    outliers = "printf('%d outliers (%.1f%%)', p.zz, p.zz / p.nrows * 100)"
    nas = "printf('%d NA (%.1f%%)', p.nulls, p.nulls / p.nrows * 100)"
    detail = f"concat_ws(', ', CASE WHEN p.zz > 0 THEN {outliers} END, CASE WHEN p.nulls > 0 THEN {nas} END)"
    return f"""
    SELECT CASE st WHEN 'STATISTICAL_IMPUTE' THEN 'IMPUTE' WHEN 'SYNTHETIC_SYNTHESIS' THEN 'SYNTHESIS'
                   WHEN 'DROP' THEN 'DROP' ELSE 'MANUAL' END AS tool, p.col AS "column",
      CASE st WHEN 'STATISTICAL_IMPUTE' THEN concat(
                CASE WHEN p.kind = 'string' OR p.semantic = 'categorical' THEN 'Mode' ELSE 'Median' END,
                ' Impute', CASE WHEN {detail} = '' THEN '' ELSE concat(' (', {detail}, ')') END)
              WHEN 'SYNTHETIC_SYNTHESIS' THEN CASE WHEN p.rare_binary OR p.rare_target
                THEN printf('Generate +%d synthetic rows to balance class', (SELECT needed FROM balance))
                ELSE printf('Gaussian Synthesis (%d outliers (%.1f%%))', p.zz, p.zz / p.nrows * 100) END
              WHEN 'DROP' THEN printf('Drop column (%d NA (%.1f%%), preserves all records)',
                                      p.nulls, p.nulls / p.nrows * 100)
              ELSE concat('Manual override: ', split_part(st, ':', 2)) END AS description
    FROM (SELECT *, {strategy} AS st FROM advised) a
    JOIN (SELECT *, CASE WHEN far_out THEN z ELSE 0 END AS zz FROM judged) p ON p.col = a."column" """


def _lines() -> str:
    line = (
        "concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, "
        "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END, "
        "CASE WHEN c_custkey % 7 = 0 THEN 'extra' END)"
    )
    fields = "2 + (c_custkey % 11 <> 0)::INT + (c_custkey % 7 = 0)::INT"
    return f"SELECT {line} AS row FROM customer WHERE {fields} <> 3"


def _types() -> str:
    names = " ".join(
        f"WHEN '{duck}' THEN '{spark}'"
        for duck, spark in {
            "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
        }.items()
    )
    parts = [
        f"SELECT {i} AS ord, '{c}' AS \"column\", '{k}' AS kind, "
        f"CASE typeof(any_value({c})) {names} END AS dtype FROM src"
        for i, (c, k) in enumerate(dirty_kinds().items())
    ]
    return f"WITH src AS ({dirty_sql()}) " + " UNION ALL ".join(parts)


# entries of a plan's ledger: inference, profile, stripping, one per aliased column
_PLANNED = "3 + (SELECT count(DISTINCT col) FROM aliased)"

ADVICE_ENTRY = (
    "concat('• ''', a.\"column\", ''' (', a.description, '):', chr(10), "
    "'  ➜ Recommended Decision: ', a.strategy, chr(10), '  ➜ Decision Impact: ', a.impact)"
)
_SOURCE_OF_MERGE = """
SELECT coalesce(a.ord, 2147483647) AS ord, coalesce(a."column", m.c) AS "column",
       coalesce(m.s, a.strategy) AS strategy,
       CASE WHEN m.s IS NULL THEN 'recommended' ELSE 'operator' END AS source
FROM advised a FULL JOIN (VALUES ('age', 'MANUAL_INPUT:40'), ('country', 'STATISTICAL_IMPUTE')) m(c, s)
ON m.c = a."column" """
_EVENT_VALUE = f"""
WITH m AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM events),
bad AS (SELECT event_id, value, (value < 0 OR value > 400 OR abs(value - mean) / sd > 3) AS bad
        FROM events, m),
ok AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM bad WHERE NOT bad)
SELECT event_id, CASE WHEN bad THEN round_even(least(greatest({normal(SEED, 'value', 'event_id')} * ok.sd
  + ok.mean, 0.0), least(400.0, ok.mean + 3 * ok.sd)), 2) ELSE value END AS value FROM bad, ok"""

# positions in the table without its dropped column
_AFTER_DROP = f"(ord - (ord > {ALL.index('sparse')})::INT)"

ORACLES = {
    "src_csv": dirty_sql(),
    "src_validate": _lines(),
    "src_sample_rows": f"SELECT * FROM {DIRTY} ORDER BY customer_id LIMIT 5",
    "src_sample_values": _samples(),
    "src_dirty_gen": _dirty_gen(),
    "snk_csv": source("dirty", strip=True)[0],
    "snk_audit": dirty_profile(
        "SELECT \"column\", strategy, 'Human Approved' AS authorization FROM advised", strip=True
    ),
    "ledger_status": dirty_profile(
        f"""SELECT 'run-1' AS run_id, 'dirty' AS source, CAST(NULL AS VARCHAR) AS target,
              false AS is_completed, count(*) > 0 AS is_waiting, 42 AS seed, {_PLANNED} AS entries,
              true AS timed, CAST(NULL AS BOOLEAN) AS has_duration FROM issues""",
        strip=True,
        extra=ALIAS_STAGES,
    ),
    "prof_type": _types(),
    "prof_rowcount": "SELECT count(*) AS total_rows, 11 AS total_columns FROM lineitem",
    "prof_nulls": dirty_profile(
        'SELECT ord, col AS "column", nrows AS rows, nulls, round(nulls / nrows, 4) AS null_ratio FROM stats'
    ),
    "prof_nunique": dirty_profile('SELECT ord, col AS "column", n_unique FROM stats'),
    "prof_uniqueness": dirty_profile(
        'SELECT ord, col AS "column", n_unique, filled, round(n_unique / filled, 6) AS uniqueness FROM stats'
    ),
    "prof_moments": _moments("dirty"),
    "prof_moments_lineitem": _moments("lineitem"),
    "prof_value_counts": dirty_profile(
        f'SELECT ord, col AS "column", v AS value, n FROM counts'
    ),
    "prof_unique_values": dirty_profile(
        "SELECT ord, col AS \"column\", v AS value FROM counts "
        "WHERE ord IN (SELECT ord FROM stats WHERE kind = 'string')"
    ),
    "prof_high_null": dirty_profile(
        "SELECT \"column\", ratio, message FROM issues WHERE type = 'HIGH_NULL_RATIO'"
    ),
    "prof_bounds": dirty_profile(
        "SELECT \"column\", count, ratio, low, high, message FROM issues WHERE type = 'INVALID_BOUNDS'"
    ),
    "prof_zscore": dirty_profile(
        "SELECT \"column\", count, ratio, message FROM issues WHERE type = 'STATISTICAL_OUTLIER'"
    ),
    "prof_binary_detect": "SELECT * FROM ("
    + dirty_profile(
        "SELECT ord, col AS \"column\", binary2 AS binary FROM judged WHERE checked AND kind = 'integer'"
    )
    + ") UNION ALL SELECT * FROM ("
    + profile_sql(
        "labels",
        "SELECT ord + 100 AS ord, col AS \"column\", binary2 AS binary FROM judged WHERE kind = 'integer'",
        overrides={"spec": NO_SPEC.format(target="false")},
    )
    + ")",
    "prof_imbalance_binary": profile_sql(
        "labels",
        "SELECT \"column\", ratio, minority_value, message FROM issues WHERE type = 'CLASS_IMBALANCE'",
        overrides={"spec": NO_SPEC.format(target="false")},
    ),
    "prof_imbalance_target": profile_sql(
        "customer",
        "SELECT \"column\", ratio, minority_value, message FROM issues WHERE type = 'CLASS_IMBALANCE'",
        overrides={"spec": NO_SPEC.format(target="col = 'c_mktsegment'")},
    ),
    "prof_role_skip": dirty_profile('SELECT col AS "column", role, checked, nulls FROM judged'),
    "prof_labels": dirty_profile(
        f"""SELECT ord, col AS "column", coalesce(nullif(concat_ws(', ',
          CASE WHEN checked AND nulls > 0 THEN printf({lit(fixed.LABEL_NULLS)}, nulls, nulls / nrows * 100) END,
          CASE WHEN bad_bounds THEN printf({lit(fixed.LABEL_BOUNDS)}, oob, oob / nrows * 100) END,
          CASE WHEN rare_binary THEN printf({lit(fixed.LABEL_IMBALANCE)}, minority_n / total * 100) END,
          CASE WHEN far_out THEN printf({lit(fixed.LABEL_OUTLIERS)}, z, z / nrows * 100) END,
          CASE WHEN rare_target THEN printf({lit(fixed.LABEL_IMBALANCE)}, minority_n / total * 100) END),
          ''), '{fixed.LABEL_HEALTHY}') AS status FROM judged"""
    ),
    "prof_issues": dirty_profile(f"SELECT {ISSUE_COLUMNS} FROM issues"),
    **{
        f"prof_issues_{t}": profile_sql(t, f"SELECT {ISSUE_COLUMNS} FROM issues")
        for t in ("lineitem", "events", "documents", "labels")
    },
    "prof_issues_domains": profile_sql(
        "lineitem", f"SELECT {ISSUE_COLUMNS} FROM issues", overrides={"spec": DOMAINS_SPEC}
    ),
    "prof_summary_table": _summary(),
    "inf_id": _rule("id", "dirty", "labels", "events"),
    "inf_ignore_text": _rule("ignore_text", "dirty", "documents", "part"),
    "inf_binary": _rule("binary", "dirty", "labels", "lineitem"),
    "inf_minority": dirty_profile(
        """SELECT a.col AS "column", a.v AS minority_value, a.n AS minority_n,
             b.v AS mode_value, b.n AS mode_n
           FROM ranked a JOIN ranked b USING (ord)
           WHERE a.least = 1 AND b.most = 1"""
    ),
    "inf_nominal": _rule("nominal", "customer", "part", "orders"),
    "inf_discrete": _rule("discrete", "dirty", "lineitem", "conversations"),
    "inf_bounds": dirty_profile('SELECT col AS "column", low, high FROM spec WHERE low IS NOT NULL'),
    "inf_alias_key": dirty_profile(
        'SELECT col AS "column", alias, canonical FROM pass1', strip=True, extra=ALIAS_STAGES
    ),
    "inf_alias_acronym": dirty_profile(
        'SELECT col AS "column", alias, canonical FROM pass2', strip=True, extra=ALIAS_STAGES
    ),
    "inf_alias_sample": """
        SELECT 'part' AS "column", CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem
        GROUP BY ALL ORDER BY n DESC, value LIMIT 500""",
    "inf_default": _rule("default", "events", "orders", "embeddings"),
    "inf_target": f"SELECT * FROM ({dirty_profile('SELECT target FROM target')}) UNION ALL "
    f"SELECT * FROM ({profile_sql('labels', 'SELECT target FROM target')})",
    "inf_override": dirty_profile(
        f"SELECT {ISSUE_COLUMNS} FROM issues", overrides={"spec": OVERRIDE_SPEC}
    ),
    "inf_schema": dirty_profile(f"SELECT {SPEC_COLUMNS} FROM spec"),
    **{
        f"inf_schema_{t}": profile_sql(t, f"SELECT {SPEC_COLUMNS} FROM spec")
        for t in ("lineitem", "orders", "part", "documents")
    },
    "cln_strip": "SELECT "
    + ", ".join(f"{stripped(c)} AS {c}" if k == "string" else c for c, k in dirty_kinds().items())
    + f" FROM {DIRTY}",
    "cln_alias": f"""SELECT customer_id, CASE country WHEN 'US' THEN 'United States' WHEN 'USA' THEN 'US'
        WHEN 'united states ' THEN 'United States' ELSE country END AS country FROM {DIRTY}""",
    "cln_pipeline": dirty_profile(
        "SELECT * FROM cleaned",
        strip=True,
        extra={**ALIAS_STAGES, "cleaned": _cleaned()},
    ),
    "adv_group": dirty_profile('SELECT "column", ord, types, n_issues, null_ratio FROM grouped'),
    "adv_describe": dirty_profile('SELECT "column", description FROM grouped'),
    "adv_strategy": dirty_profile('SELECT "column", strategy FROM advised'),
    "adv_impact": dirty_profile(
        f'SELECT a."column", a.impact, {ADVICE_ENTRY} AS advice FROM advised a'
    ),
    "adv_parse": dirty_profile(
        """SELECT a."column", m.advised FROM advised a
           JOIN (VALUES ('age', 'DROP'), ('churn', 'STATISTICAL_IMPUTE')) m(c, advised) ON m.c = a."column" """
    ),
    "adv_merge": dirty_profile(_SOURCE_OF_MERGE),
    "man_actions": dirty_profile(
        _man_actions("CASE WHEN \"column\" = 'age' THEN 'MANUAL_INPUT:40' ELSE strategy END")
    ),
    "man_files": f"""
        SELECT 0 AS ord, '[READ]' AS action, 'dirty' AS path, count(*) || ' rows' AS description FROM ({DIRTY}) UNION ALL
        SELECT * FROM (VALUES (1, '[CREATE]', '/clean/dirty/data', ''), (2, '[CREATE]', '/clean/dirty/decisions', ''),
          (3, '[CREATE]', '/clean/dirty/delta', ''), (4, '[CREATE]', '/clean/dirty/profile', ''),
          (5, '[CREATE]', '/clean/dirty/residual', ''), (6, '[CREATE]', '/clean/dirty/report', ''),
          (7, '[WRITE]', '/clean/dirty/ledger', 'State: run-1'))""",
    "man_forecast": dirty_profile(
        "SELECT (SELECT target FROM target) AS \"column\", needed FROM balance"
    ),
    "man_dryrun": dirty_profile(
        f"""SELECT * FROM ({_man_actions('strategy')})
        UNION ALL SELECT 'CLEAN', 'strings', '{fixed.ACTION_STRIP}'
        UNION ALL SELECT DISTINCT 'CLEAN', col, '{fixed.ACTION_ALIAS}' FROM aliased""",
        strip=True,
        extra=ALIAS_STAGES,
    ),
    "rem_dispatch": dirty_profile(
        f"""SELECT customer_id, {_imputed('age', 'BIGINT')},
          CASE WHEN {_mask('balance')} THEN 12.5 ELSE balance END AS balance,
          coalesce(country, 'DefaultCat') AS country, market FROM src"""
    ),
    "rem_drop": f"SELECT customer_id, age, balance, country, market, segment, nation_code, churn FROM {DIRTY}",
    "rem_impute_median": dirty_profile(
        f"SELECT customer_id, {_imputed('age', 'BIGINT')}, {_imputed('balance')} FROM src"
    ),
    "rem_impute_mode": dirty_profile(
        f"""SELECT customer_id, coalesce(country, {_mode('country')}) AS country,
          coalesce(nation_code, CAST({_mode('nation_code')} AS INT)) AS nation_code FROM src"""
    ),
    "rem_impute_unsupported": "SELECT event_id, ts IS NULL AS ts_missing, user_id FROM events",
    "rem_manual": dirty_profile(
        f"""SELECT customer_id, CASE WHEN {_mask('age')} THEN 75 ELSE age END AS age,
          CASE WHEN {_mask('balance')} THEN 0.25 ELSE balance END AS balance,
          coalesce(country, 'Unknown') AS country, nation_code, churn FROM src"""
    ),
    "rem_anomaly_mask": dirty_profile(
        "SELECT customer_id, "
        + ", ".join(f"{_mask(c)} AS {c}_anomalous" for c in ("age", "balance", "sparse"))
        + " FROM src"
    ),
    "rem_gauss_replace": dirty_profile(
        "SELECT customer_id, "
        + _gauss("age", "customer_id", _stat("age", "low"), _stat("age", "high"), True)
        + ", "
        + _gauss("balance", "customer_id", _stat("balance", "low"), _stat("balance", "high"), False)
        + " FROM src"
    ),
    "rem_gauss_outliers": _EVENT_VALUE,
    "rem_gauss_keyless": """
        WITH keyed AS (SELECT l_returnflag, l_linenumber, l_quantity,
          md5(concat_ws(chr(31), l_returnflag, l_linenumber, l_quantity)) AS digest FROM lineitem),
        src AS (SELECT * EXCLUDE digest, CASE WHEN count(*) OVER w = 1 THEN digest
          ELSE 'again|' || digest || '|' || (row_number() OVER w - 1) END AS k
          FROM keyed WINDOW w AS (PARTITION BY l_returnflag, l_linenumber, l_quantity))
        SELECT l_returnflag, l_linenumber, GAUSS FROM src""".replace("GAUSS", _gauss("l_quantity", "k", "5.0", "45.0", False)),
    "rem_synth_skip": f"SELECT customer_id, country FROM {DIRTY}",
    "rem_chain": _rem_chain(),
    "syn_needed": dirty_profile(
        "SELECT nrows AS rows, '1' AS minority_value, minority_n AS minority, needed FROM balance"
    ),
    "syn_rows": _synthetic(),
    "syn_id": f"""SELECT customer_id AS id FROM ({_synthetic(['customer_id'])}) UNION ALL
        SELECT CAST(greatest(b.nrows + 1000, b.top + 1) + i AS VARCHAR) FROM (
          SELECT count(*) AS nrows, max(doc_id) AS top, unnest(range(CAST(trunc(
            (CAST(0.35 AS DOUBLE) * count(*) - least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)))
            / CAST(0.65 AS DOUBLE)) AS BIGINT))) AS i FROM labels) b""",
    "syn_numeric": _synthetic(["customer_id", "age", "balance", "sparse", "nation_code"]),
    "syn_categorical": _synthetic(["customer_id", "country", "market", "segment"]),
    "syn_weighted": _weighted(),
    "syn_pii": _pii(),
    "syn_null": f"{_SMALL} SELECT {_SYN_ID}, CAST(NULL AS VARCHAR) AS nothing, 1 AS churn FROM {ROWS}",
    "syn_cast_union": dirty_profile(_union()),
    "syn_balance": dirty_profile(
        """SELECT nrows + needed AS total, minority_n + needed AS minority,
             round((minority_n + needed) / (nrows + needed), 6) AS ratio FROM balance"""
    ),
    "syn_seed": _synthetic(["customer_id", "age", "balance"], seed=999),
    "ver_reprofile": dirty_profile(
        f"""SELECT {_AFTER_DROP} * 10 + 2 AS ord, col AS "column", 'CLASS_IMBALANCE' AS type,
              CAST(NULL AS BIGINT) AS count, round(minority_n / total, 4) AS ratio, CAST(NULL AS DOUBLE) AS low,
              CAST(NULL AS DOUBLE) AS high, minority AS minority_value,
              printf({lit(fixed.MSG_IMBALANCE)}, col, minority, minority_n / total * 100) AS message
            FROM judged WHERE rare_binary
            UNION ALL
            SELECT {_AFTER_DROP} * 10 + 3, col, 'STATISTICAL_OUTLIER', z, round(z / nrows, 9), NULL, NULL, NULL,
              printf({lit(fixed.MSG_OUTLIER)}, col, z, z / nrows * 100)
            FROM after WHERE z > 0 AND role NOT IN ('id', 'ignore')""",
        extra=_after_stages(),
    ),
    "ver_delta": dirty_profile(
        """SELECT b.ord, b.col AS "column", b.nrows AS rows_before, b.nulls AS nulls_before,
             b.oob AS out_of_bounds_before, CASE WHEN b.far_out THEN b.z ELSE 0 END AS outliers_before,
             a.nrows AS rows_after, a.nulls AS nulls_after, a.oob AS out_of_bounds_after, a.z AS outliers_after,
             a.nrows - b.nrows AS rows_delta, a.nulls - b.nulls AS nulls_delta,
             a.oob - b.oob AS out_of_bounds_delta,
             a.z - CASE WHEN b.far_out THEN b.z ELSE 0 END AS outliers_delta
           FROM judged b LEFT JOIN after a USING (ord) WHERE b.kind <> 'string'
           UNION ALL
           SELECT b.ord, b.col, b.nrows, b.nulls, NULL, NULL, d.nrows, d.nulls, NULL, NULL, d.nrows - b.nrows, d.nulls - b.nulls,
             NULL, NULL
           FROM judged b JOIN texts d ON d.col = b.col WHERE b.kind = 'string'""",
        extra=_after_stages()
        | {
            "texts": " UNION ALL ".join(
                f"SELECT '{c}' AS col, count(*) AS nrows, count(*) - count({c}) AS nulls FROM done"
                for c, k in dirty_kinds().items()
                if k == "string"
            )
        },
    ),
    "ver_telemetry": dirty_profile(
        f"""SELECT 'dirty' AS source, 'nowhere' AS target, true AS is_completed, false AS is_waiting,
              7 AS seed, {_PLANNED} + count(*) + 1 AS entries, true AS timed, true AS has_duration
            FROM advised""",
        strip=True,
        extra=ALIAS_STAGES,
    ),
    "pipe_plan": dirty_profile(
        'SELECT "column", types, description, strategy, impact FROM advised', strip=True
    ),
    "pipe_apply": _pipe_apply(),
}
# the parts of an export hold what the operators return
ORACLES |= {
    "snk_audit_data": ORACLES["pipe_apply"],
    "snk_audit_delta": ORACLES["ver_delta"],
    "snk_audit_residual": ORACLES["ver_reprofile"],
}
