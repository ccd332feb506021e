"""ANSI-SQL (DuckDB dialect) twins of the role tables and of shared expressions.

Used only to build the oracle SQL strings of ``oracle_sql()``; the Spark side
never parses these.
"""

from __future__ import annotations

from collections.abc import Sequence

# Python str.isspace() characters as an RE2 class body.
WS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

NA_TOKENS_SQL = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', "
                 "'1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', "
                 "'n/a', 'nan', 'null'")


def strip(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '\\A[{WS}]+', ''), "
            f"'[{WS}]+\\z', '')")


def clean(x: str, lowercase: bool = True, punctuation: bool = False) -> str:
    e = strip(f"coalesce(CAST({x} AS VARCHAR), '')")
    if lowercase:
        e = f"lower({e})"
    if punctuation:
        e = f"regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"
    return strip(f"regexp_replace({e}, '[{WS}]+', ' ', 'g')")


def na(x: str) -> str:
    return f"CASE WHEN {x} IN ({NA_TOKENS_SQL}) THEN NULL ELSE {x} END"


def tokens(x: str) -> str:
    """Word tokens of a cleaned text (list), empty strings removed."""
    return f"list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


ROLES = {
    "products": "SELECT doc_id, text AS product_title, lang AS category FROM documents",
    "products_short": "SELECT p_partkey, p_name AS product_title, p_type AS category FROM part",
    "scored": ("SELECT doc_id, lang AS y_true, CASE WHEN doc_id % 11 = 0 THEN 'xx' "
               "WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS y_pred, "
               "CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 AS confidence FROM documents"),
    "scored_by_user": ("SELECT doc_id, source AS user_id, lang AS y_true, CASE WHEN doc_id % 11 = 0 "
                       "THEN 'xx' WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS y_pred, "
                       "CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 AS confidence FROM documents"),
    "accounts": ("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name "
                 "FROM customer"),
    "transactions": (
        "SELECT o_orderkey AS id, o_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS user_id, "
        "CASE WHEN o_orderstatus = 'F' THEN 'income' ELSE 'expense' END AS type, "
        "CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderpriority AS category, "
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '3-MEDIUM' "
        "ELSE o_orderpriority END AS predicted, CAST(o_orderdate AS DATE) AS transaction_date "
        "FROM orders JOIN customer ON o_custkey = c_custkey"),
    "transfers": (
        "SELECT o_orderkey AS id, o_custkey AS from_account_id, "
        "(o_custkey + 1) % (SELECT count(*) FROM customer) AS to_account_id, "
        "CAST(o_totalprice AS DECIMAL(15,2)) AS amount, "
        "CAST(round(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(15,2)) AS fee "
        "FROM orders WHERE o_orderstatus = 'P'"),
    "feedback": (
        "SELECT event_id, user_id, event_id AS transaction_id, ts AS created_at, "
        "CASE event_type WHEN 'purchase' THEN 'confirmation' WHEN 'error' THEN 'correction' "
        "WHEN 'view' THEN 'rejection' END AS feedback_type, "
        "CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS DECIMAL(5,4)) AS prediction_confidence, "
        "CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS predicted_category_id, "
        "CASE WHEN event_type = 'error' THEN (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) % 5 "
        "ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 END AS correct_category_id, "
        "CAST(json_extract_string(props, '$.k') AS INTEGER) >= 5 AS is_used_for_training "
        "FROM events WHERE event_type IN ('purchase', 'error', 'view', 'click')"),
    "training_runs": (
        "SELECT event_id AS run_id, user_id, ts AS trained_at, 'completed' AS status, "
        "CAST(floor(value) AS BIGINT) AS duration_seconds FROM events WHERE event_type = 'signup'"),
    "request_log": (
        "SELECT event_id, user_id, ts, value AS latency_ms, event_type = 'error' AS is_error "
        "FROM events"),
}


def with_roles(names: Sequence[str], body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    ctes = [f"{n} AS ({ROLES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra]
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):  # merge the body's own CTE list
        return "WITH " + ",\n".join(ctes) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def part_by(by: Sequence[str]) -> str:
    return ("PARTITION BY " + ", ".join(by)) if by else ""


def cols(by: Sequence[str], trailing: bool = True) -> str:
    if not by:
        return ""
    return ", ".join(by) + (", " if trailing else "")


def using(keys: Sequence[str]) -> str:
    return "USING (" + ", ".join(keys) + ")"


# --- metric SQL over a CTE named `src` with y_true, y_pred ---------------------------

def per_class_ctes(by: Sequence[str]) -> list[tuple[str, str]]:
    b = cols(by)
    return [
        ("ct", f"SELECT {b}y_true, y_pred, count(*) AS n FROM src GROUP BY ALL"),
        ("tside", f"SELECT {b}y_true AS label, sum(n) AS support, "
                  f"sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM ct "
                  f"WHERE y_true IS NOT NULL GROUP BY ALL"),
        ("pside", f"SELECT {b}y_pred AS label, sum(n) AS n_pred FROM ct "
                  f"WHERE y_pred IS NOT NULL GROUP BY ALL"),
        ("pc0", f"SELECT {b}label, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, "
                f"coalesce(support, 0) AS support FROM tside FULL JOIN pside {using(list(by) + ['label'])}"),
        ("pc", f"SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision, "
               f"CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, "
               f"CASE WHEN support + n_pred = 0 THEN 0.0 ELSE 2 * tp / (support + n_pred) END AS f1 "
               f"FROM pc0"),
        ("av", f"SELECT {b}sum(tp) AS s_tp, sum(support) AS s_sup, sum(n_pred) AS s_pred, "
               f"avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, "
               f"CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END AS w_precision, "
               f"CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END AS w_recall, "
               f"CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END AS w_f1 "
               f"FROM pc GROUP BY ALL"),
        ("tot", f"SELECT {b}sum(n) AS n, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS correct "
                f"FROM ct GROUP BY ALL"),
    ]


def evaluate_select(by: Sequence[str], average: str = "weighted") -> str:
    if average == "weighted":
        p, r, f = "w_precision", "w_recall", "w_f1"
    elif average == "macro":
        p, r, f = "macro_precision", "macro_recall", "macro_f1"
    else:
        p = "CASE WHEN s_pred = 0 THEN 0.0 ELSE s_tp / s_pred END"
        r = "CASE WHEN s_sup = 0 THEN 0.0 ELSE s_tp / s_sup END"
        f = "CASE WHEN s_sup + s_pred = 0 THEN 0.0 ELSE 2 * s_tp / (s_sup + s_pred) END"
    j = f"tot LEFT JOIN av {using(by)}" if by else "tot, av"
    return (f"SELECT {cols(by)}CAST(n AS BIGINT) AS n, round(correct / n, 6) AS accuracy, "
            f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, "
            f"round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, "
            f"round(macro_f1, 6) AS macro_f1 FROM {j}")


def split_ctes(key: str, label: str, by: Sequence[str], test_size: float, val_size: float,
               seed: int, stratify: bool) -> list[tuple[str, str]]:
    """CTEs over `src` ending in `assigned(key, split)`."""
    by = list(by)
    val_adj = val_size / (1.0 - test_size)
    gb = part_by(by)
    gl = by + [label]
    s = "TRUE" if stratify else "FALSE"
    return [
        ("hs", f"SELECT *, md5('{seed}|' || CAST({key} AS VARCHAR)) AS _h FROM src"),
        ("rk", f"SELECT *, row_number() OVER (PARTITION BY {', '.join(gl)} ORDER BY _h, {key}) AS r_c, "
               f"row_number() OVER ({gb} ORDER BY _h, {key}) AS r_g FROM hs"),
        ("cc", f"SELECT {cols(gl, False)}, count(*) AS c FROM src GROUP BY ALL"),
        ("p1a", f"SELECT *, sum(c) OVER ({gb}) AS n, count(*) OVER ({gb}) AS k, "
                f"min(c) OVER ({gb}) AS min_c FROM cc"),
        ("p1b", f"SELECT *, CAST(ceil(n * {test_size!r}) AS BIGINT) AS n_test FROM p1a"),
        ("p1c", f"SELECT *, n - n_test AS n_tr1, ({s} AND min_c >= 2 AND n_test >= k AND n - n_test >= k) AS strat1, "
                f"CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n - n_test AS DOUBLE) AS cont FROM p1b"),
        ("p1d", "SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM p1c"),
        ("p1e", f"SELECT *, n_tr1 - sum(fl) OVER ({gb}) AS need, "
                f"row_number() OVER ({gb} ORDER BY rem DESC, {label}) AS rr FROM p1d"),
        ("p1", f"SELECT {cols(gl)}n_test, strat1, c - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS tq FROM p1e"),
        ("x", f"SELECT rk.*, n_test, strat1, tq, CASE WHEN strat1 THEN r_c <= tq ELSE r_g <= n_test END AS is_test "
              f"FROM rk JOIN p1 {using(gl)}"),
        ("xt", f"SELECT *, sum(CASE WHEN NOT is_test THEN 1 ELSE 0 END) OVER ({gb} ORDER BY _h, {key} "
               f"ROWS UNBOUNDED PRECEDING) AS r_t FROM x"),
        ("tt", f"SELECT {cols(gl)}sum(CASE WHEN NOT is_test THEN 1 ELSE 0 END) AS tc, count(*) AS c2 "
               f"FROM x GROUP BY ALL"),
        ("p2a", f"SELECT *, sum(tc) OVER ({gb}) AS n_temp, count(*) OVER ({gb}) AS k2, "
                f"min(tc) OVER ({gb}) AS min_tc FROM tt WHERE tc > 0"),
        ("p2b", f"SELECT *, CAST(ceil(n_temp * {val_adj!r}) AS BIGINT) AS n_val, "
                f"floor(n_temp * {val_adj!r}) AS iv FROM p2a"),
        ("p2c", f"SELECT *, n_temp - n_val AS n_tr2, ({s} AND k2 > 1 AND min_tc >= 2 AND iv >= k2 "
                f"AND n_temp - iv >= k2) AS strat2, "
                f"CAST(tc AS DOUBLE) / CAST(n_temp AS DOUBLE) * CAST(n_temp - n_val AS DOUBLE) AS cont FROM p2b"),
        ("p2d", "SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM p2c"),
        ("p2e", f"SELECT *, n_tr2 - sum(fl) OVER ({gb}) AS need, "
                f"row_number() OVER ({gb} ORDER BY rem DESC, {label}) AS rr FROM p2d"),
        ("p2", f"SELECT {cols(gl)}n_val, strat2, tc, c2, tc - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS vq FROM p2e"),
        ("assigned", f"SELECT xt.*, CASE WHEN is_test THEN 'test' WHEN (CASE WHEN strat2 THEN r_c - (c2 - tc) <= vq "
                     f"ELSE r_t <= n_val END) THEN 'val' ELSE 'train' END AS split "
                     f"FROM xt LEFT JOIN p2 {using(gl)}"),
    ]
