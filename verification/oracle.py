"""DuckDB twins of the registered queries, as plain SQL over the whole tables."""

from __future__ import annotations

from veritab.spec import TableSpec

SEED, RATE = 42, 0.05


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(lit(v) for v in values)


def digest(stage: str, *keys: str, seed: int = SEED) -> str:
    return f"md5('{seed}|{stage}|' || " + " || '|' || ".join(f"({k})::VARCHAR" for k in keys) + ")"


def integer(md5: str) -> str:
    return f"('0x' || substr({md5}, 1, 15))::BIGINT"


def fraction(md5: str) -> str:
    return f"({integer(md5)}::DOUBLE / {float(16**15)!r}::DOUBLE)"


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE"


def values_rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def misspelled(source: str, spec: TableSpec) -> str:
    """(id, col, typo) for the (id, col, v, dig) rows of ``source``."""
    banned = names(spec.all_labels) or "NULL"
    return f"""
      SELECT id, col, coalesce(min_by(t, pos) FILTER (WHERE point < reach), max_by(t, pos)) AS typo FROM (
        SELECT *, sum(weight) OVER (PARTITION BY id, col ORDER BY pos ROWS UNBOUNDED PRECEDING) AS reach,
               {fraction('dig')} * sum(weight) OVER (PARTITION BY id, col) AS point
        FROM (
          SELECT id, col, v, dig, 1000 + i AS pos, 1.0::DOUBLE / (length(v) - 1) AS weight,
                 substr(v, 1, i - 1) || substr(v, i + 1, 1) || substr(v, i, 1) || substr(v, i + 2) AS t
          FROM (SELECT *, unnest(range(1, length(v))) AS i FROM {source})
          UNION ALL
          SELECT id, col, v, dig, 2000 + i, 1.0::DOUBLE / length(v), substr(v, 1, i - 1) || substr(v, i + 1)
          FROM (SELECT *, unnest(range(1, length(v) + 1)) AS i FROM {source})
          UNION ALL SELECT id, col, v, dig, 3001, 0.5, upper(substr(v, 1, 1)) || lower(substr(v, 2)) FROM {source}
          UNION ALL SELECT id, col, v, dig, 3002, 0.5, upper(v) FROM {source}
          UNION ALL SELECT id, col, v, dig, 4001, 0.5, v || ' ' FROM {source}
          UNION ALL SELECT id, col, v, dig, 4002, 0.5, ' ' || v FROM {source}
        ) WHERE t <> v AND t <> '' AND t NOT IN ({banned})
      ) GROUP BY id, col"""


def injected(spec: TableSpec, table: str, seed: int = SEED, rate: float = RATE) -> str:
    """CTEs: base, budget, picks, inj (id + features + duplicate_of), truth (id, col, label)."""
    feats, cats = spec.features, spec.categories
    cast = ", ".join(f"{c}::DOUBLE AS {c}" if c in spec.numbers else c for c in feats)
    stage_cols = {
        "missing": feats, "out_of_range": list(spec.bad_values),
        "category_typo": cats, "unit_inconsistency": list(spec.units),
    }
    ctes = [
        f"base AS MATERIALIZED (SELECT {spec.id_col}::BIGINT AS id, {cast} FROM {table})",
        f"budget AS MATERIALIZED (SELECT greatest(1, round_even({rate}::DOUBLE * count(*), 0)::BIGINT) AS k, max(id) AS last FROM base)",
        "cells AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT id, '{c}' AS col FROM base WHERE {c} IS NOT NULL" for c in feats) + ")",
    ]
    done = []
    for stage, cols in stage_cols.items():
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM pick_{d} p WHERE p.id = c.id AND p.col = c.col)" for d in done)
        ctes.append(
            f"pick_{stage} AS MATERIALIZED (SELECT id, col FROM (SELECT id, col, row_number() OVER (ORDER BY "
            f"{digest(stage, 'id', 'col', seed=seed)}) AS rn FROM cells c WHERE col IN ({names(cols)}){free}) "
            f"WHERE rn <= (SELECT k FROM budget))"
        )
        done.append(stage)
    ctes.append("picks AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT id, col, '{s}' AS label FROM pick_{s}" for s in stage_cols) + ")")
    ctes.append("typo_in AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT b.id, '{c}' AS col, b.{c} AS v, {digest('category_typo_text', 'b.id', lit(c), seed=seed)} AS dig "
        f"FROM base b JOIN pick_category_typo p ON p.id = b.id AND p.col = '{c}'" for c in cats) + ")")
    ctes.append(f"typos AS MATERIALIZED ({misspelled('typo_in', spec)})")
    cols, joins = [], []
    for i, c in enumerate(feats):
        whens = ["WHEN 'missing' THEN NULL"]
        if c in spec.bad_values:
            bad = ", ".join(f"{float(v)!r}::DOUBLE" for v in spec.bad_values[c])
            n = len(spec.bad_values[c])
            whens.append(f"WHEN 'out_of_range' THEN ([{bad}])[({integer(digest('bad_value', 'b.id', lit(c), seed=seed))} % {n} + 1)::INT]")
        if c in cats:
            whens.append(f"WHEN 'category_typo' THEN t{i}.typo")
            joins.append(f"LEFT JOIN typos t{i} ON t{i}.id = b.id AND t{i}.col = '{c}'")
        if c in spec.units:
            u = spec.units[c]
            moved = f"b.{c} {'/' if u.divide else '*'} {float(u.factor)!r}::DOUBLE"
            whens.append(f"WHEN 'unit_inconsistency' THEN " + (moved if u.digits is None else f"round_even({moved}, {u.digits})"))
        cols.append(f"CASE p{i}.label {' '.join(whens)} ELSE b.{c} END AS {c}")
        joins.append(f"LEFT JOIN picks p{i} ON p{i}.id = b.id AND p{i}.col = '{c}'")
    ctes.append("dirty_base AS MATERIALIZED (SELECT b.id, " + ", ".join(cols) + " FROM base b " + " ".join(joins) + ")")
    place, kind = digest("near_column", "id", seed=seed), digest("near_kind", "id", seed=seed)
    sign = f"CASE WHEN {fraction(digest('near_sign', 'id', seed=seed))} < 0.5 THEN -1 ELSE 1 END"
    ctes.append(
        "chosen AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY "
        f"{digest('duplicate', 'id', seed=seed)}) AS rn FROM base WHERE id NOT IN (SELECT id FROM picks)) "
        "WHERE rn <= 2 * (SELECT k FROM budget))"
    )
    ctes.append(
        f"copies AS MATERIALIZED (SELECT *, rn > (SELECT k FROM budget) AS near, {fraction(kind)} < 0.5 AS nudge, "
        f"{integer(place)} % {len(spec.nudge)} AS nudge_at, {integer(place)} % {len(cats)} AS typo_at FROM chosen)"
    )
    ctes.append("near_in AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT id, '{c}' AS col, {c} AS v, {digest('near_typo_text', 'id', lit(c), seed=seed)} AS dig FROM copies "
        f"WHERE near AND NOT nudge AND typo_at = {i}" for i, c in enumerate(cats)) + ")")
    ctes.append(f"near_typos AS MATERIALIZED ({misspelled('near_in', spec)})")
    cols = []
    for c in feats:
        if c in spec.nudge:
            i = list(spec.nudge).index(c)
            cols.append(f"CASE WHEN near AND nudge AND nudge_at = {i} THEN {c} + ({sign}) ELSE {c} END AS {c}")
        elif c in cats:
            cols.append(f"CASE WHEN n.col = '{c}' THEN n.typo ELSE {c} END AS {c}")
        else:
            cols.append(c)
    sign_fixed = ", ".join(cols)
    ctes.append(
        "copied AS MATERIALIZED (SELECT id, rn, near, " + sign_fixed.replace("n.col", "ncol").replace("n.typo", "ntypo")
        + " FROM (SELECT c.*, n.col AS ncol, n.typo AS ntypo FROM copies c LEFT JOIN near_typos n ON n.id = c.id))"
    )
    flist = ", ".join(feats)
    ctes.append(
        f"inj AS MATERIALIZED (SELECT id, {flist}, NULL::BIGINT AS duplicate_of FROM dirty_base UNION ALL "
        f"SELECT (SELECT last FROM budget) + rn, {flist}, id FROM copied)"
    )
    dup = "CASE WHEN near THEN 'near_duplicate' ELSE 'exact_duplicate' END"
    ctes.append(
        f"truth AS MATERIALIZED (SELECT id, col, label FROM picks UNION ALL SELECT (SELECT last FROM budget) + rn, "
        f"unnest([{names(feats)}]), {dup} FROM copied)"
    )
    ctes.append(
        "row_truth AS MATERIALIZED (SELECT i.id, t.types IS NOT NULL AS is_dirty, coalesce(t.types, '') AS error_types, "
        "i.duplicate_of FROM inj i LEFT JOIN (SELECT id, string_agg(DISTINCT label, ';' ORDER BY label) AS types "
        "FROM truth GROUP BY id) t ON t.id = i.id)"
    )
    return "WITH " + ",\n".join(ctes)


def rule_label(spec: TableSpec, c: str, later: str | None) -> str:
    whens = [f"WHEN {c} IS NULL THEN 'missing'"]
    if c in spec.ranges:
        low, high = spec.ranges[c]
        whens.append(f"WHEN {c} < {low} OR {c} > {high} THEN 'out_of_range'")
    if c in spec.allowed:
        whens.append(f"WHEN {c} NOT IN ({names(spec.allowed[c])}) THEN 'category_typo'")
    if later:
        whens.append(f"WHEN {later} THEN 'exact_duplicate'")
    return f"CASE {' '.join(whens)} ELSE '' END"


def rules(spec: TableSpec) -> str:
    """CTEs after ``injected``: mask (wide) and said (id, col, label)."""
    feats = ", ".join(spec.features)
    labels = ", ".join(f"{rule_label(spec, c, 'later')} AS {c}" for c in spec.features)
    said = " UNION ALL ".join(
        f"SELECT id, '{c}' AS col, {c} AS label FROM mask WHERE {c} <> ''" for c in spec.features)
    return (
        f",\nmask AS MATERIALIZED (SELECT id, {labels} FROM (SELECT *, row_number() OVER (PARTITION BY {feats} ORDER BY id) > 1 "
        f"AS later FROM inj)),\nsaid AS MATERIALIZED ({said})"
    )


def stats(spec: TableSpec, source: str, columns=None) -> str:
    """CTE st: one row with med_, mad_, std_, iqr_ and fstd_ (after imputing) per number column."""
    cols = columns or spec.numbers
    med = ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS med_{c}" for c in cols)
    parts = []
    for c in cols:
        filled = f"coalesce({c}::DOUBLE, med_{c})"
        parts += [
            f"any_value(med_{c}) AS med_{c}", f"quantile_cont(abs({c}::DOUBLE - med_{c}), 0.5) AS mad_{c}",
            f"stddev_samp({c}::DOUBLE) AS std_{c}",
            f"quantile_cont({filled}, 0.75) - quantile_cont({filled}, 0.25) AS iqr_{c}",
            f"stddev_samp({filled}) AS fstd_{c}",
        ]
    return (
        f"med AS MATERIALIZED (SELECT {med} FROM {source}),\n"
        f"st AS MATERIALIZED (SELECT {', '.join(parts)} FROM {source}, med)"
    )


def spread(c: str) -> str:
    return f"CASE WHEN mad_{c} > 0 THEN 1.4826 * mad_{c} WHEN std_{c} > 0 THEN std_{c} ELSE 1.0 END"


def width(c: str) -> str:
    return f"CASE WHEN iqr_{c} > 0 THEN iqr_{c} WHEN fstd_{c} > 0 THEN fstd_{c} ELSE 1.0 END"


def cell_features(spec: TableSpec, source: str, id_col: str) -> str:
    """One SELECT per column of ``source`` joined with ``st``."""
    lower = all(a == a.lower() for a in spec.all_labels)
    blocks = []
    for c in spec.features:
        freq = f"CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {c})::DOUBLE / count({c}) OVER () END"
        head = f"SELECT {id_col}, '{c}' AS \"column\", ({c} IS NULL)::INT AS is_null, {r6(freq)} AS value_freq"
        if c in spec.numbers:
            outside = "0"
            if c in spec.ranges:
                low, high = spec.ranges[c]
                outside = f"CASE WHEN {c} IS NULL THEN 0 ELSE (greatest({low} - {c}, 0) + greatest({c} - {high}, 0)) / {float(high - low)!r}::DOUBLE END"
            body = (
                f"{r6(f'coalesce({c}, 0)')} AS value, {r6(f'coalesce(({c} - med_{c}) / ({spread(c)}), 0)')} AS robust_z, "
                f"{r6(f'CASE WHEN med_{c} = 0 THEN 0 ELSE coalesce({c} / med_{c}, 0) END')} AS ratio_to_median, "
                f"{r6(outside)} AS dist_outside_range, 1 AS in_allowed_set, 0 AS edit_dist_to_allowed, 0 AS has_whitespace, 0 AS case_mismatch"
            )
        else:
            allowed = spec.allowed.get(c, ())
            valid = f"{c} IN ({names(allowed)})" if allowed else f"{c} IS NOT NULL"
            edit = "0"
            if allowed:
                options = ", ".join(f"levenshtein({c}, {lit(a)})" for a in allowed)
                edit = f"CASE WHEN {c} IS NULL OR {c} = '' THEN 0 ELSE least({options}) END"
            wrong = f"{c} <> lower({c})" if lower else (
                f"{c} NOT IN ({names(allowed)}) AND lower({c}) IN ({names(a.lower() for a in allowed)})" if allowed else "false")
            body = (
                f"0.0::DOUBLE AS value, 0.0::DOUBLE AS robust_z, 0.0::DOUBLE AS ratio_to_median, 0.0::DOUBLE AS dist_outside_range, "
                f"coalesce({valid}, false)::INT AS in_allowed_set, ({edit})::INT AS edit_dist_to_allowed, "
                f"coalesce(regexp_matches({c}, '^\\s|\\s$'), false)::INT AS has_whitespace, coalesce({wrong}, false)::INT AS case_mismatch"
            )
        blocks.append(f"{head}, {body} FROM {source}, st")
    return " UNION ALL ".join(blocks)


def scaled(spec: TableSpec, source: str, id_col: str) -> str:
    """CTE zs: id, z_ numbers, t_ categories."""
    nums = ", ".join(
        f"(coalesce({c}::DOUBLE, med_{c}) - med_{c}) / ({width(c)}) AS z_{c}" for c in spec.numbers)
    # Whole numbers compare much faster than text; missing is a number of its own.
    cats = ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS t_{c}" for c in spec.categories)
    return f"zs AS MATERIALIZED (SELECT {id_col} AS id, {nums}, {cats} FROM {source}, st)"


def pair_distance(spec: TableSpec) -> str:
    parts = [f"abs(a.z_{c} - b.z_{c})" for c in spec.numbers]
    parts += [f"(a.t_{c} <> b.t_{c})::INT::DOUBLE" for c in spec.categories]
    return f"round(({' + '.join(parts)}) * 1e9) / 1e9"


def nearest(spec: TableSpec, extra: str = "") -> str:
    """CTE pairs: id, partner, distance over all earlier records."""
    return (
        f"pairs AS MATERIALIZED (SELECT a.id, arg_min(b.id, (d, b.id)) AS partner, min(d) AS distance FROM zs a, zs b, "
        f"LATERAL (SELECT {pair_distance(spec)} AS d) WHERE b.id < a.id{extra} GROUP BY a.id)"
    )


def nearest_of_many(spec: TableSpec) -> str:
    """The same pairs in two passes that hold no list of pairs: the least distance, then its smallest id."""
    d = pair_distance(spec)
    return (
        f"least AS MATERIALIZED (SELECT a.id, min({d}) AS distance FROM zs a JOIN zs b ON b.id < a.id GROUP BY a.id), "
        "za AS MATERIALIZED (SELECT zs.*, least.distance AS best FROM zs JOIN least USING (id)), "
        f"pairs AS MATERIALIZED (SELECT a.id, min(b.id) AS partner, any_value(a.best) AS distance FROM za a JOIN zs b ON b.id < a.id AND {d} = a.best GROUP BY a.id)"
    )


def keyed_pairs(spec: TableSpec) -> str:
    """CTE pairs: the nearest earlier record that differs in one column at most."""
    columns = [f"z_{c}" for c in spec.numbers] + [f"t_{c}" for c in spec.categories]
    joins = []
    for left_out in columns:
        same = " AND ".join(f"a.{c} = b.{c}" for c in columns if c != left_out)
        joins.append(f"SELECT a.id, b.id AS partner, {pair_distance(spec)} AS d FROM zs a JOIN zs b ON {same} AND b.id < a.id")
    return (
        "pairs AS MATERIALIZED (SELECT id, arg_min(partner, (d, partner)) AS partner, min(d) AS distance FROM ("
        + " UNION ALL ".join(joins) + ") GROUP BY id)"
    )


def type_scores(pairs: str, types, level: str, method: str) -> str:
    """Scores from a (t, g, flagged) relation; one row per type."""
    rows = values_rows([(lit(e),) for e in types])
    return f"""
      SELECT {lit(method)} AS method, e.error_type, {lit(level)} AS level, support,
             CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall,
             CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * hits / (support + predicted) ELSE 0 END AS f1,
             CASE WHEN support > 0 THEN caught::DOUBLE / support END AS recall_any
      FROM (SELECT e.error_type, count(*) FILTER (WHERE t = e.error_type) AS support,
                   count(*) FILTER (WHERE g = e.error_type) AS predicted,
                   count(*) FILTER (WHERE t = e.error_type AND g = e.error_type) AS hits,
                   count(*) FILTER (WHERE t = e.error_type AND flagged) AS caught
            FROM {pairs} p CROSS JOIN (VALUES {rows}) e(error_type) GROUP BY e.error_type) e"""


def scoring(spec: TableSpec) -> str:
    """CTEs cell_pairs, dup_pairs, marked rows from truth and said."""
    half = f"count(*) * 2 > {len(spec.features)}"
    return f""",
cell_pairs AS MATERIALIZED (SELECT t.label AS t, s.label AS g, s.label IS NOT NULL AS flagged
  FROM truth t FULL JOIN said s ON t.id = s.id AND t.col = s.col),
maj_t AS MATERIALIZED (SELECT id, label FROM truth GROUP BY id, label HAVING {half}),
maj_s AS MATERIALIZED (SELECT id, label FROM said GROUP BY id, label HAVING {half}),
dup_pairs AS MATERIALIZED (SELECT t.label AS t, s.label AS g, coalesce(t.id, s.id) IN (SELECT id FROM said) AS flagged
  FROM maj_t t FULL JOIN maj_s s ON t.id = s.id)"""


def row_scores(flagged: str, method: str, auc: str = "NULL::DOUBLE", rows: str = "row_truth") -> str:
    return f"""
      SELECT {lit(method)} AS method, 'any_error' AS error_type, 'row' AS level, support,
             CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall,
             CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * hits / (support + predicted) ELSE 0 END AS f1,
             CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall_any, {auc} AS roc_auc
      FROM (SELECT count(*) FILTER (WHERE is_dirty) AS support, count(*) FILTER (WHERE f) AS predicted,
                   count(*) FILTER (WHERE is_dirty AND f) AS hits
            FROM (SELECT is_dirty, id IN ({flagged}) AS f FROM {rows}))"""
