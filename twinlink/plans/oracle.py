"""DuckDB SQL for the correctness oracle.

The oracle sees only the raw test tables, so every statement starts from the
fixture written here in plain SQL (same rules as ``sources.fixtures``), packed
into the same canonical ``attrs`` list of structs.
"""

from __future__ import annotations

from twinlink.sources.fixtures import FIXTURE_DATASETS, PARTNERS_PER_RECORD


def _records_sql(spec) -> str:
    cols = ", ".join(f"{a.column} AS {a.name}" for a in spec.attrs)
    a = f"{spec.name}_a AS (SELECT {spec.id_col} AS id, {cols} FROM {spec.table})"
    b_cols = []
    for at in spec.attrs:
        n = at.name
        if n == "name":
            b_cols.append("CASE WHEN id % 5 = 1 THEN upper(name) WHEN id % 5 = 3 THEN name || ' new' "
                          "ELSE name END AS name")
        elif n == "price":
            b_cols.append("CASE WHEN id % 5 = 2 THEN NULL ELSE price END AS price")
        elif n == "brand":
            b_cols.append("CASE WHEN id % 5 = 4 THEN '-' ELSE brand END AS brand")
        else:
            b_cols.append(n)
    b = f"{spec.name}_b AS (SELECT id, {', '.join(b_cols)} FROM {spec.name}_a)"
    return a + ",\n" + b


def _ids_sql(spec) -> str:
    return (f"{spec.name}_ids AS (SELECT DISTINCT id AS ltable_id, CASE WHEN j = 0 THEN id "
            f"ELSE (id * 7 + j * 13 + 1) % (SELECT count(*) FROM {spec.table}) END AS rtable_id "
            f"FROM {spec.name}_a, range({PARTNERS_PER_RECORD}) t(j))")


def _text(col: str, numeric: bool) -> str:
    return f"CAST({col} AS VARCHAR)" if numeric else col


def _pairs_sql(spec) -> str:
    structs = ", ".join(
        f"{{'name': '{a.name}', 'left': {_text('a.' + a.name, a.numeric)}, "
        f"'right': {_text('b.' + a.name, a.numeric)}, 'numeric': {str(a.numeric).lower()}}}"
        for a in spec.attrs)
    pid = f"'{spec.name}|' || i.ltable_id || '|' || i.rtable_id"
    return (f"{spec.name}_pairs AS (SELECT {pid} AS pair_id, '{spec.name}' AS dataset, "
            f"CASE WHEN substr(md5({pid}), 1, 1) < 'a' THEN 'train' "
            f"WHEN substr(md5({pid}), 1, 1) < 'd' THEN 'valid' ELSE 'test' END AS split, "
            f"CAST(i.ltable_id = i.rtable_id AS INTEGER) AS label, [{structs}] AS attrs "
            f"FROM {spec.name}_ids i JOIN {spec.name}_a a ON a.id = i.ltable_id "
            f"JOIN {spec.name}_b b ON b.id = i.rtable_id)")


def fixture_ctes(specs=FIXTURE_DATASETS) -> str:
    """CTE list ending in ``pairs(pair_id, dataset, split, label, attrs)``."""
    parts = []
    for s in specs:
        parts += [_records_sql(s), _ids_sql(s), _pairs_sql(s)]
    union = " UNION ALL ".join(f"SELECT * FROM {s.name}_pairs" for s in specs)
    parts.append(f"pairs AS ({union})")
    return ",\n".join(parts)


def with_fixture(*ctes: str, select: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return f"WITH {fixture_ctes()}{extra}\n{select}"


def record_text_sql(side: str, sep: str, attrs: str = "attrs") -> str:
    return (f"array_to_string(list_transform({attrs}, lambda a: coalesce(a.{side}, 'nan')), "
            f"'{sep}')")


def side_text_sql(side: str, with_names: bool, attrs: str = "attrs") -> str:
    item = (f"a.name || ': ' || coalesce(a.{side}, 'N/A')" if with_names
            else f"'COL ' || coalesce(a.{side}, 'N/A')")
    return f"array_to_string(list_transform({attrs}, lambda a: {item}), ', ')"


def serialise_sql(mode: str, attrs: str = "attrs") -> str:
    from twinlink.operators.serialise import QUESTION_AFTER, QUESTION_BEFORE
    left = side_text_sql("left", mode == "mode4", attrs)
    right = side_text_sql("right", mode == "mode4", attrs)
    if mode == "mode1":
        return (f"'Record A is <p>' || {left} || '</p>. Record B is <p>' || {right} || "
                f"'</p>. {QUESTION_AFTER}'")
    if mode == "mode2":
        return (f"'{QUESTION_BEFORE} Record A is <p>' || {left} || '</p>. Record B is <p>' || "
                f"{right} || '</p>.'")
    return f"'{QUESTION_BEFORE} Record A is ' || {left} || '. Record B is ' || {right} || '.'"


def metrics_select_sql(source: str, by: str = "dataset") -> str:
    """R2-R4 over ``source(by…, prediction, label)``."""
    return f"""
SELECT {by}, n_pairs, tp, fp, fn, tn,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
  CASE WHEN n_pairs = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / n_pairs END AS accuracy
FROM (SELECT {by}, CAST(count(*) AS BIGINT) AS n_pairs,
        CAST(count(*) FILTER (WHERE prediction = 1 AND label = 1) AS BIGINT) AS tp,
        CAST(count(*) FILTER (WHERE prediction = 1 AND label <> 1) AS BIGINT) AS fp,
        CAST(count(*) FILTER (WHERE prediction <> 1 AND label = 1) AS BIGINT) AS fn,
        CAST(count(*) FILTER (WHERE prediction <> 1 AND label <> 1) AS BIGINT) AS tn
      FROM {source} GROUP BY {by})"""


def null_token_sql(x: str) -> str:
    from twinlink.functions.nulls import ATTRIBUTE_NULL_TOKENS
    toks = ", ".join("'" + t + "'" for t in ATTRIBUTE_NULL_TOKENS)
    return f"({x} IS NULL OR {x} IN ({toks}))"


def attribute_label_sql(l: str, r: str, numeric: str, row_label: str) -> str:
    ln, rn = null_token_sql(l), null_token_sql(r)
    return f"""CASE WHEN {ln} AND NOT {rn} THEN 0 WHEN NOT {ln} AND {rn} THEN 0 WHEN {ln} AND {rn} THEN 1
  WHEN {numeric} AND TRY_CAST({l} AS DOUBLE) IS NOT NULL AND TRY_CAST({r} AS DOUBLE) IS NOT NULL
       THEN CAST(TRY_CAST({l} AS DOUBLE) = TRY_CAST({r} AS DOUBLE) AS INTEGER)
  WHEN lower({l}) = lower({r}) OR contains(lower({l}), lower({r})) OR contains(lower({r}), lower({l})) THEN 1
  ELSE {row_label} END"""


ATTR_PAIRS_CTES = (
    "ex AS (SELECT pair_id, dataset, split, label AS row_label, unnest(attrs) AS a FROM pairs)",
    "lab AS (SELECT pair_id, dataset, split, a.name AS attribute, a.left AS left_value, "
    "a.right AS right_value, " + attribute_label_sql("a.left", "a.right", "a.numeric", "row_label")
    + " AS label FROM ex)",
    "ap AS (SELECT dataset || '#' || md5(concat_ws(chr(31), " + ", ".join(
        f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')" if c != "label" else "CAST(label AS VARCHAR)"
        for c in ("dataset", "split", "attribute", "label", "left_value", "right_value"))
    + ")) AS attr_pair_id, dataset, split, attribute, left_value, right_value, label FROM "
    "(SELECT DISTINCT dataset, split, attribute, left_value, right_value, label FROM lab))",
)

RULE_PRED_SQL = ("CAST(coalesce(lower(list_filter(attrs, lambda a: a.name = 'name')[1].left) "
                 "= lower(list_filter(attrs, lambda a: a.name = 'name')[1].right), false) AS INTEGER)")


def key_sql(seed: int, op: str, id_col: str = "pair_id") -> str:
    return f"md5('{seed}|{op}|' || {id_col})"


def automl_filter_cte(name: str = "m4", source: str = "tr", seed: int = 42, small_set: int = 1200,
                      max_pos: int = 400) -> list[str]:
    """M4 over ``source(pair_id, dataset, split, label, attrs, prediction)``."""
    return [
        f"{name}_c AS (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE label = 1) AS pos "
        f"FROM {source} GROUP BY dataset)",
        f"{name}_r AS (SELECT s.*, row_number() OVER (PARTITION BY dataset, label ORDER BY "
        f"CASE WHEN label = 1 AND prediction = label THEN 1 ELSE 0 END, {key_sql(seed, 'automl_filter')}, "
        f"pair_id) AS rn FROM {source} s)",
        f"{name} AS (SELECT r.pair_id, r.dataset, r.split, r.label, r.attrs FROM {name}_r r "
        f"JOIN {name}_c c USING (dataset) WHERE c.total < {small_set} "
        f"OR (r.label = 1 AND r.rn <= least({max_pos}, c.pos)) "
        f"OR (r.label = 0 AND r.rn <= 2 * least({max_pos}, c.pos)))",
    ]


VKEY = "list_transform(attrs, lambda a: {'name': a.name, 'left': a.left, 'right': a.right})"
ATTR_AS_PAIR = "[{'name': 'value', 'left': left_value, 'right': right_value}]"


def flip_sql(src: str) -> str:
    return (f"SELECT pair_id || '#f' AS pair_id, dataset, split, label, list_transform(attrs, lambda a: "
            f"{{'name': a.name, 'left': a.right, 'right': a.left, 'numeric': a.numeric}}) AS attrs FROM {src}")


def permute_ctes(src: str, name: str, seed: int = 42) -> list[str]:
    def sh(side):
        return (f"list_sort(list_transform(attrs, lambda a, i: {{'k': md5('{seed}|permute|' || pair_id || "
                f"'|{side}|' || (i - 1)), 'v': a.{side}, 'n': a.numeric}}))")
    return [
        f"{name}_k AS (SELECT *, {sh('left')} AS ls, {sh('right')} AS rs FROM {src})",
        f"{name} AS (SELECT pair_id || '#p' AS pair_id, dataset, split, label, list_transform(attrs, "
        f"lambda a, i: {{'name': a.name, 'left': rs[i].v, 'right': ls[i].v, 'numeric': rs[i].n AND ls[i].n}}) "
        f"AS attrs FROM {name}_k)",
    ]


def dedup_sql(src: str) -> str:
    """G4 over ``src`` -> pair_id, dataset, split, label, vkey."""
    rank = "{'copy': suffix(pair_id, '#f') OR suffix(pair_id, '#p'), 'id': pair_id}"
    return (f"SELECT min({rank}).id AS pair_id, dataset, split, label, {VKEY} AS vkey FROM {src} "
            f"GROUP BY dataset, split, label, {VKEY}")


def strip_sql(x: str) -> str:
    from twinlink.functions.text import WHITESPACE_CLASS_RE2 as ws
    return f"regexp_replace({x}, '^[{ws}]+|[{ws}]+$', '', 'g')"


def count_tokens_sql(x: str) -> str:
    from twinlink.functions.text import WHITESPACE_CLASS_RE2 as ws
    s = strip_sql(x)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN 0 "
            f"ELSE len(regexp_split_to_array({s}, '[{ws}]+')) END")
