"""The same queries as SQL over the plain test tables, one statement per registered query."""

from voc_spark import taxonomy as tx
from voc_spark.functions import text as words
from voc_spark.operators import questions
from voc_spark.operators.classify import few_shot_messages
from voc_spark.operators.windows import STAT_KEYS
from voc_spark.plans.catalog import LOOKUP_ID, QUESTIONS
from voc_spark.schemas import required_columns
from voc_spark.sources import demo_tables as demo


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nth(number: str, values) -> str:
    """values[number mod len]"""
    return f"({array(values)})[(({number}) % {len(values)}) + 1]"


CATEGORY = nth("l_orderkey + l_linenumber", tx.FEEDBACK_CATEGORIES)

BASE = f"""
raw_reviews AS (
  SELECT CAST(p_partkey AS VARCHAR) AS asin, CAST(o_custkey AS VARCHAR) AS user_id, p_type AS product_category,
         p_name AS product_title, CAST(1 + CAST(l_quantity AS INT) % 9 * 0.5 AS DOUBLE) AS rating,
         l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 3571) % 86400) AS ts,
         (l_linestatus = 'F') AS verified_purchase, l_orderkey, l_linenumber, l_extendedprice,
         {nth("l_orderkey", demo.PHRASES)} || ' ' || p_name AS review_text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
raw AS (SELECT *, epoch_ms(ts) AS "timestamp", asin || '_' || user_id AS review_id FROM raw_reviews),
reviews AS (
  SELECT review_id, product_category, product_title, review_text, rating, ts AS review_ts,
         CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE ts END AS review_date,
         CASE WHEN ts <= TIMESTAMP '{demo.Q1_END}' THEN 'Q1' ELSE 'Q2' END AS quarter,
         verified_purchase, l_orderkey, l_linenumber
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts, l_orderkey, l_linenumber, l_extendedprice) AS rn
        FROM raw) t WHERE rn = 1),
classifications AS (
  SELECT review_id, {CATEGORY} AS feedback_category,
         {nth("l_orderkey + 2 * l_linenumber", ["Positive", "Neutral", "Negative"])} AS sentiment,
         {nth("l_orderkey", ["High", "Medium", "Low", "Low"])} AS urgency,
         'rule' AS reasoning, review_ts + to_days(1) AS classified_at
  FROM reviews WHERE l_orderkey % 10 <> 0
  UNION ALL
  SELECT review_id, 'Not As Described', 'Negative', 'High', 'second pass', review_ts + to_days(2)
  FROM reviews WHERE l_orderkey % 50 = 1
  UNION ALL
  SELECT 'orphan_' || review_id, 'Not As Described', 'Negative', 'High', 'orphan', review_ts + to_days(1)
  FROM reviews WHERE l_orderkey % 1999 = 1),
joined AS (
  SELECT r.review_id, r.product_category, r.product_title, r.review_text, r.rating, r.review_date, r.quarter,
         r.verified_purchase, c.feedback_category, c.sentiment, c.urgency, c.reasoning, c.classified_at
  FROM reviews r LEFT JOIN classifications c ON r.review_id = c.review_id),
cover AS (SELECT count(*) AS row_count, min(review_date) AS lo, max(review_date) AS hi FROM reviews)"""

TEXTS = f"""
text_reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS product_category,
         {nth("doc_id", demo.PHRASES)} || ' ' || text AS review_text, lang, doc_id,
         {nth("doc_id", demo.PHRASE_CATEGORY)} AS gold_category
  FROM documents)"""

WINDOWS = f"""
report_windows AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(q, w)) + ")" for w in demo.WINDOWS)})
    AS t(window_label, date_start, date_end)),
all_windows AS (
  SELECT * FROM report_windows UNION ALL
  SELECT 'w' || o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN '1997-13-01' WHEN o_orderkey % 97 = 0 THEN CAST(o_orderdate AS DATE) || ' 12:00:00'
           ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 - 10 AS INT) AS VARCHAR) FROM orders)"""


def plain(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({c} AS DATE) END"


def bad_dates(a: str, b: str) -> str:
    return f"({a} IS NOT NULL AND {b} IS NOT NULL AND ({plain(a)} IS NULL OR {plain(b)} IS NULL))"


def bad_message(a: str, b: str) -> str:
    x, y, z = tx.BAD_DATES_FORMAT.split("%s")
    return f"{q(x)} || {a} || {q(y)} || {b} || {q(z)}"


def spec_pick(modulus: int, values) -> str:
    return nth(f"o_orderkey // {modulus}", values)


SPECS = f"""
specs AS (
  SELECT o_orderkey AS spec_id, {nth("o_orderkey", ["count", "breakdown", "chart", "summary"])} AS query_type,
         CASE WHEN k % 4 = 1 THEN {spec_pick(4, ["sentiment", "quarter", "rating", "product_category"])} END AS breakdown_column,
         CASE WHEN k % 4 = 2 THEN {spec_pick(4, ["urgency", "asin", "verified_purchase"])} END AS group_by_column,
         CASE WHEN k % 3 = 0 THEN {spec_pick(3, ["ECONOMY", "PROMO", "Unknown", "LARGE"])} END AS product_category,
         CASE WHEN k % 5 = 0 THEN {spec_pick(5, ["Praise/Positive", "Not As Described", "Other"])} END AS feedback_category,
         CASE WHEN k % 2 = 0 THEN {spec_pick(2, ["Negative", "Positive", "Mixed"])} END AS sentiment,
         CASE WHEN k % 8 = 3 THEN {spec_pick(8, ["High", "Low", "Urgent"])} END AS urgency,
         CASE WHEN k % 9 = 0 THEN (k // 9) % 2 = 0 END AS verified_purchase,
         CASE WHEN k % 83 = 0 THEN 'soon' WHEN k % 79 = 0 THEN (CASE WHEN k % 7 = 0 THEN d + 60 WHEN k % 11 = 0 THEN d - 4000 ELSE d END) || ' 12:00'
              WHEN k % 17 <> 0 THEN CAST(CASE WHEN k % 7 = 0 THEN d + 60 WHEN k % 11 = 0 THEN d - 4000 ELSE d END AS VARCHAR) END AS date_start,
         CASE WHEN k % 19 <> 0 THEN CAST(CASE WHEN k % 13 = 0 THEN d + 4000 ELSE d + CAST(k % 50 AS INT) END AS VARCHAR) END AS date_end,
         'request ' || k AS explanation,
         string_split({nth("k", ["bar", "line,bar", "pie,pie", "line,line,pie", "scatter", "bar,radar,bar", ""])}, ',') AS chart_types
  FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) o)"""

SAMPLE = f"""
windowed AS (
  SELECT *, ts AS review_date, CASE WHEN ts <= TIMESTAMP '{demo.Q1_END}' THEN 'Q1' ELSE 'Q2' END AS quarter,
         CASE WHEN rating <= 2 THEN 'low' WHEN rating = 3 THEN 'mid' WHEN rating >= 4 THEN 'high' END AS band
  FROM raw WHERE ts BETWEEN TIMESTAMP '{demo.WINDOW[0]}' AND TIMESTAMP '{demo.WINDOW[1]}'),
quota AS (
  SELECT product_category, least(count(*) FILTER (band = 'low'), {int(200 * tx.LOW_SHARE)}) AS low,
         least(count(*) FILTER (band = 'mid'), {int(200 * tx.MID_SHARE)}) AS mid FROM windowed GROUP BY 1),
sample AS (
  SELECT w.* EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY product_category, band ORDER BY
             md5(concat_ws('|', asin, user_id, "timestamp", l_orderkey, l_linenumber, '42')), asin, user_id, "timestamp",
             l_orderkey, l_linenumber) AS rk FROM windowed WHERE band IS NOT NULL) w
  JOIN quota USING (product_category)
  WHERE rk <= CASE band WHEN 'low' THEN low WHEN 'mid' THEN mid ELSE 200 - low - mid END)"""


def with_base(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([BASE, *ctes]) + "\n" + body


def snapshot(n: int) -> str:
    return f"""
snapshot AS (SELECT * FROM joined ORDER BY review_date DESC NULLS FIRST, review_id, classified_at NULLS FIRST,
             feedback_category NULLS FIRST, sentiment NULLS FIRST, urgency NULLS FIRST, reasoning NULLS FIRST LIMIT {n})"""


def marginals(table: str) -> str:
    parts = [f"SELECT 'total' AS dimension, 'all' AS value, count(*) AS count FROM {table}"]
    parts += [
        f"SELECT '{d}', {d}, count(*) FROM {table} WHERE {d} IS NOT NULL GROUP BY {d}" for d in tx.FILTER_DIMENSIONS
    ]
    return " UNION ALL ".join(parts)


def in_list(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def window_counts(windows: str) -> str:
    dims = ", ".join(tx.FILTER_DIMENSIONS)
    parts = [
        f"SELECT window_label, '{d}' AS dimension, {d} AS value, sum(n) AS n FROM cells WHERE {d} IS NOT NULL GROUP BY ALL"
        for d in tx.FILTER_DIMENSIONS
    ]
    parts.append("SELECT window_label, 'total', 'all', sum(n) FROM cells GROUP BY ALL")
    parts.append(
        "SELECT window_label, 'complaints_by_product', product_category, sum(n) FROM cells"
        f" WHERE feedback_category IN {in_list(tx.COMPLAINTS)} GROUP BY ALL"
    )
    return f"""
cells AS (SELECT window_label, {dims}, count(*) AS n FROM joined j JOIN {windows} w
  ON j.review_date BETWEEN CAST({plain("w.date_start")} AS TIMESTAMP) AND CAST({plain("w.date_end")} AS TIMESTAMP) GROUP BY ALL),
counts AS (SELECT window_label, dimension, value, CAST(n AS BIGINT) AS count FROM ({" UNION ALL ".join(parts)}) u)"""


NARRATIVE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY window_label, dimension ORDER BY count DESC, value) AS rk FROM counts),
facts AS (
  SELECT window_label, max(count) FILTER (dimension = 'total') AS total,
         string_agg(value || ' (' || count || ')', ', ' ORDER BY rk) FILTER (dimension = 'feedback_category' AND rk <= 3) AS themes,
         max(value) FILTER (dimension = 'complaints_by_product' AND rk = 1) AS worst,
         max(count) FILTER (dimension = 'complaints_by_product' AND rk = 1) AS worst_n,
         CAST(coalesce(sum(count) FILTER (dimension = 'complaints_by_product'), 0) AS BIGINT) AS complaints,
         coalesce(max(count) FILTER (dimension = 'sentiment' AND value = 'Negative'), 0) AS negative,
         coalesce(max(count) FILTER (dimension = 'urgency' AND value = 'High'), 0) AS high,
         first(value ORDER BY rk) FILTER (dimension = 'feedback_category' AND value IN {in_list(tx.COMPLAINTS)}) AS driver
  FROM ranked GROUP BY 1),
narratives AS (
  SELECT window_label, concat_ws(' ', total || ' reviews in ' || window_label || '.', 'Main themes: ' || themes || '.',
    worst || ' draws the most complaints, ' || worst_n || ' of ' || complaints || '.',
    negative || ' are negative (' || (negative * 100 // total) || '%) and ' || high || ' are of high urgency.',
    coalesce('Start with ' || driver || ' in ' || worst || '.', 'No complaint stands out.')) AS narrative FROM facts)"""

def out_of_range(lo: str, hi: str) -> str:
    a, b, c = tx.OUT_OF_RANGE_FORMAT.split("%s")
    return f"{q(a)} || CAST({lo} AS DATE) || {q(b)} || CAST({hi} AS DATE) || {q(c)}"


OVERLAP = f"""
overlap AS (
  SELECT w.*, is_valid, CASE WHEN {bad_dates("date_start", "date_end")} THEN {bad_message("date_start", "date_end")}
    WHEN NOT is_valid THEN {out_of_range("lo", "hi")} END AS message
  FROM (SELECT *, coalesce({plain("date_end")} >= lo AND {plain("date_start")} <= hi, false) AS is_valid FROM all_windows, cover) w)"""

_ENTRIES = lambda d: f"coalesce(string_agg('\"' || value || '\":' || count, ',' ORDER BY value) FILTER (dimension = '{d}'), '')"
JSONS = f"""
jsons AS (SELECT window_label, '{{"total_count":' || max(count) FILTER (dimension = 'total') || ',"category_counts":{{' || {_ENTRIES("feedback_category")}
  || '}},"sentiment_counts":{{' || {_ENTRIES("sentiment")} || '}},"urgency_counts":{{' || {_ENTRIES("urgency")}
  || '}},"product_category_counts":{{' || {_ENTRIES("product_category")} || '}}}}' AS stats FROM counts GROUP BY 1)"""
SUMMARIES = """
summaries AS (SELECT window_label, date_start, date_end, count AS total_reviews, stats, narrative, true AS stamped
  FROM all_windows JOIN counts USING (window_label) JOIN narratives USING (window_label) JOIN jsons USING (window_label) WHERE dimension = 'total')"""


def rules(table: str) -> str:
    """The word-list rules over `table`, as CTE `labelled`."""
    # Words two blanks apart, so that each match owns the blanks around it.
    pattern = " (" + "|".join(t.replace(" ", "  ") for t in words.ALL_TERMS) + ") "

    def hit_list(terms):
        return array(t.replace(" ", "  ") for t in terms)

    def first(terms):
        return f"list_filter(hits, lambda h: list_contains({hit_list(terms)}, h))[1]"

    n = [f"len(list_filter(hits, lambda h: list_contains({hit_list(t)}, h)))" for t in words.COMPLAINT_TERMS.values()]
    counted = ", ".join(f"{c} AS n{i}" for i, c in enumerate(n))
    most = "greatest(n0, n1, n2, n3, n4, n5)"
    pick = " ".join(f"WHEN n{i} = {most} THEN {q(c)}" for i, c in enumerate(tx.COMPLAINTS))
    term = " ".join(
        f"WHEN {q(c)} THEN {first(t)}" for c, t in [*words.COMPLAINT_TERMS.items(), (tx.PRAISE, words.POSITIVE_TERMS)]
    )
    complaint = f"feedback_category IN {in_list(tx.COMPLAINTS)}"
    return f"""
found AS (SELECT *, regexp_extract_all('  ' || regexp_replace(lower(review_text), '[^\\p{{L}}]+', '  ', 'g') || '  ',
            {q(pattern)}, 1) AS hits FROM {table}),
scored AS (SELECT *, {counted}, list_has_any(hits, {hit_list(words.NEGATIVE_TERMS)}) AS neg,
            list_has_any(hits, {hit_list(words.POSITIVE_TERMS)}) AS pos FROM found),
named AS (SELECT *, CASE WHEN pos AND NOT neg THEN {q(tx.PRAISE)} WHEN {most} > 0 THEN (CASE {pick} END)
            WHEN pos THEN {q(tx.PRAISE)} ELSE {q(tx.NO_CONTEXT)} END AS feedback_category FROM scored),
labelled AS (SELECT *, CASE WHEN pos AND NOT neg THEN 'Positive' WHEN neg OR {complaint} THEN 'Negative' ELSE 'Neutral' END AS sentiment,
            CASE WHEN NOT {complaint} THEN 'Low' WHEN list_has_any(hits, {hit_list(words.HIGH_TERMS)}) THEN 'High'
                 WHEN list_has_any(hits, {hit_list(words.SOFT_TERMS)}) THEN 'Low' ELSE 'Medium' END AS urgency,
            coalesce(feedback_category || ': says ' || replace(CASE feedback_category {term} END, '  ', ' '),
                     'No aspect of the purchase is named.') AS reasoning FROM named)"""


LABELS = "review_id, product_category, feedback_category, sentiment, urgency"
SAMPLE_COLUMNS = (
    "review_id, asin, user_id, product_category, product_title, review_text AS text, rating, \"timestamp\", review_date, quarter,"
    " verified_purchase, l_orderkey, l_linenumber")
WINDOW_FILTER = f"ts BETWEEN TIMESTAMP '{demo.WINDOW[0]}' AND TIMESTAMP '{demo.WINDOW[1]}'"
DATE_FILTER = f"review_date BETWEEN TIMESTAMP '{demo.WINDOW[0]}' AND TIMESTAMP '{demo.WINDOW[1]}'"


def _sources() -> dict[str, str]:
    return {
        "scan_reviews_parquet": with_base(
            'SELECT "timestamp", rating, asin, user_id, product_category, review_text AS text, product_title, verified_purchase FROM raw'),
        "sink_sample_parquet": with_base(f"SELECT {SAMPLE_COLUMNS} FROM sample", SAMPLE),
        "ingest_project": with_base(
            "SELECT review_id, product_category, product_title, review_text, rating, ts AS review_date,"
            f" CASE WHEN ts <= TIMESTAMP '{demo.Q1_END}' THEN 'Q1' ELSE 'Q2' END AS quarter, verified_purchase FROM raw"),
        "review_key": with_base("SELECT l_orderkey, l_linenumber, review_id FROM raw"),
        "insert_if_absent": with_base(
            "SELECT review_id, product_category, product_title, review_text AS text, rating, epoch_ms(review_ts) AS \"timestamp\","
            " verified_purchase, l_orderkey, l_linenumber FROM reviews WHERE quarter <> 'Q1'"),
        "append_classification": with_base(
            "SELECT * FROM classifications WHERE review_id IN (SELECT review_id FROM reviews)"),
        "upsert_summary": with_base(
            "SELECT window_label, date_start, date_end, total_reviews + CASE WHEN window_label < 'w3' THEN 2 ELSE 0 END AS total_reviews, stats,"
            " CASE WHEN window_label < 'w3' THEN 'revised 2' ELSE narrative END AS narrative, stamped FROM summaries",
            WINDOWS, window_counts("all_windows"), NARRATIVE, JSONS, SUMMARIES),
        "get_stored_summary": with_base(
            "SELECT * FROM summaries WHERE window_label = 'Q2 1998'", WINDOWS, window_counts("all_windows"), NARRATIVE, JSONS, SUMMARIES),
        "init_tables": with_base(
            " UNION ALL ".join(
                [f"SELECT 'reviews' AS \"table\", '{c} is not null' AS rule, count(*) FILTER ({c} IS NULL) AS violations FROM reviews" for c in required_columns("reviews")]
                + ["SELECT 'reviews', 'review_id is unique', count(review_id) - count(DISTINCT review_id) FROM reviews"]
                + [f"SELECT 'classifications', '{c} is not null', count(*) FILTER ({c} IS NULL) FROM classifications" for c in required_columns("classifications")]
                + [f"SELECT 'summaries', '{c} is not null', 0" for c in required_columns("summaries")] + ["SELECT 'summaries', 'window_label is unique', 0"])),
        "table_preview": with_base(
            "SELECT " + ", ".join(
                f"substr(CAST({c} AS VARCHAR), 1, 80) AS {c}" for c in
                ("review_id", "product_category", "product_title", "review_text", "rating", "review_date", "quarter",
                 "verified_purchase", "l_orderkey", "l_linenumber")) + " FROM reviews ORDER BY reviews.review_id LIMIT 20"),
    }


def _preparation() -> dict[str, str]:
    quartiles = ", ".join(f"quantile_cont(rating, {p / 100}) AS p{p}" for p in (25, 50, 75))
    return {
        "epoch_ms_to_ts": with_base("SELECT l_orderkey, l_linenumber, ts AS review_date FROM raw"),
        "window_filter": with_base(f"SELECT l_orderkey, l_linenumber, ts AS review_date FROM raw WHERE {WINDOW_FILTER}"),
        "quarter_label": with_base("SELECT l_orderkey, l_linenumber, review_date, quarter FROM windowed", SAMPLE),
        "rating_band": with_base(
            "SELECT product_category, coalesce(band, 'dropped') AS band, count(*) AS count FROM windowed GROUP BY ALL", SAMPLE),
        "stratified_sample": with_base(f"SELECT {SAMPLE_COLUMNS} FROM sample", SAMPLE),
        "sample_profile": with_base(
            f"""SELECT section, item, round(value, 6) AS value FROM (
  SELECT 'sample' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM sample
  UNION ALL SELECT 'sample', 'unique_ids', count(DISTINCT review_id) FROM sample
  UNION ALL SELECT 'product_category', product_category, count(*) FROM sample GROUP BY 2
  UNION ALL SELECT 'quarter', quarter, count(*) FROM sample GROUP BY 2
  UNION ALL SELECT 'rating', unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']),
     unnest([CAST(n AS DOUBLE), mean, std, lo, p25, p50, p75, hi]) FROM (
       SELECT count(rating) AS n, avg(rating) AS mean, stddev_samp(rating) AS std, min(rating) AS lo, max(rating) AS hi, {quartiles}
       FROM sample)) u""", SAMPLE),
        "audit_not_null_unique": with_base(
            """SELECT unnest(['product_category is not null', 'text is not null', 'review_date is not null', 'review_id is unique']) AS rule,
  unnest([a, b, c, n - d]) AS violations FROM (
    SELECT count(*) FILTER (raw.product_category IS NULL) AS a, count(*) FILTER (raw.review_text IS NULL) AS b,
           count(*) FILTER (reviews.review_date IS NULL) AS c, count(*) AS n, count(DISTINCT raw.review_id) AS d
    FROM raw JOIN reviews ON raw.review_id = reviews.review_id) t"""),
        "orphan_classifications": with_base(
            "SELECT * FROM classifications WHERE review_id IS NOT NULL AND review_id NOT IN (SELECT review_id FROM reviews)"),
        "validate_classification_json": with_base(
            f"""SELECT review_id,
  CASE k WHEN 1 THEN 'missing reasoning' WHEN 2 THEN 'feedback_category outside its domain' WHEN 3 THEN 'reasoning is no string'
         WHEN 4 THEN 'not a JSON object' END AS problem,
  CASE WHEN k IN (0, 5) THEN {CATEGORY} END AS feedback_category,
  CASE k WHEN 0 THEN 'Negative' WHEN 5 THEN 'Neutral' END AS sentiment, CASE k WHEN 0 THEN 'Low' WHEN 5 THEN 'High' END AS urgency,
  CASE k WHEN 0 THEN 'says ' || product_title WHEN 5 THEN 'ok' END AS reasoning
FROM (SELECT *, l_orderkey % 6 AS k FROM reviews) r"""),
    }


def _filters() -> dict[str, str]:
    pairs = [
        ("review_id", "r.review_id"), ("product_category", "product_category"), ("product_title", "product_title"),
        ("review_text", "review_text"), ("rating", "CAST(rating AS VARCHAR)"), ("review_date", "CAST(review_date AS VARCHAR)"),
        ("verified_purchase", "CASE WHEN verified_purchase THEN 'True' ELSE 'False' END"),
        ("feedback_category", "feedback_category"), ("sentiment", "sentiment"), ("urgency", "urgency"), ("reasoning", "reasoning"),
    ]
    return {
        "filter_dimension_eq": with_base(f"SELECT {LABELS} FROM joined WHERE product_category = 'PROMO' AND sentiment = 'Negative'"),
        "filter_verified": with_base(f"SELECT {LABELS}, verified_purchase FROM joined WHERE NOT verified_purchase"),
        "filter_date_between": with_base(f"SELECT {LABELS}, review_date FROM joined WHERE {DATE_FILTER}"),
        "filter_multi_select": with_base(
            f"SELECT {LABELS} FROM joined WHERE product_category IN ('ECONOMY', 'LARGE') AND sentiment IN ('Negative', 'Neutral')"),
        "drilldown_rows": with_base("SELECT * FROM joined WHERE sentiment = 'Negative' AND urgency = 'High'"),
        "date_range_overlap": with_base(
            "SELECT window_label, date_start, date_end, is_valid, message FROM overlap",
            WINDOWS, OVERLAP),
        "lookup_review": with_base(
            f"""SELECT 'keyvalue' AS kind, 'lookup' AS explanation, CAST(unnest({list(range(len(pairs)))}) AS INT) AS position,
  unnest({array(n for n, _ in pairs)}) AS label, unnest([{", ".join(f"coalesce({e}, 'None')" for _, e in pairs)}]) AS value
FROM reviews r LEFT JOIN classifications c ON r.review_id = c.review_id WHERE r.review_id = {q(LOOKUP_ID)}
QUALIFY row_number() OVER (ORDER BY classified_at DESC) = 1"""),
    }


def _joins() -> dict[str, str]:
    count_match = " AND ".join(
        f"(s.{d} IS NULL OR s.{d} = f.{d})" for d in [*tx.FILTER_DIMENSIONS, "verified_purchase"])
    dated = "s.date_start IS NOT NULL AND s.date_end IS NOT NULL"
    return {
        "feedback_view": with_base("SELECT * FROM joined"),
        "latest_reviews": with_base("SELECT * FROM snapshot", snapshot(1500)),
        "pending_reviews": with_base(
            "SELECT review_id, review_text FROM reviews WHERE review_id NOT IN (SELECT review_id FROM classifications)"),
        "latest_classification": with_base(
            "SELECT review_id, feedback_category, sentiment, urgency, reasoning, classified_at FROM classifications"
            " QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY classified_at DESC) = 1"),
        "batch_specs_count": with_base(
            f"""SELECT s.spec_id, CASE WHEN any_value({bad_dates("s.date_start", "s.date_end")}) THEN 0 ELSE CAST(coalesce(sum(f.n), 0) AS BIGINT) END AS count,
  any_value(CASE WHEN {bad_dates("s.date_start", "s.date_end")} THEN {bad_message("s.date_start", "s.date_end")} END) AS error
FROM specs s LEFT JOIN facts f
  ON {count_match} AND (NOT ({dated}) OR (f.day BETWEEN {plain("s.date_start")} AND {plain("s.date_end")}
     AND (f.day < {plain("s.date_end")} OR f.mid))) GROUP BY 1""",
            SPECS,
            "facts AS (SELECT product_category, feedback_category, sentiment, urgency, verified_purchase,"
            " CAST(review_date AS DATE) AS day, review_date = date_trunc('day', review_date) AS mid, count(*) AS n FROM joined GROUP BY ALL)"),
        "spec_list_count": with_base(
            f"""SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS spec_id, unnest([c1, c2, c3, c4, c5, c6]) AS count FROM (
  SELECT count(*) FILTER (sentiment = 'Negative') AS c1, count(*) FILTER (product_category = 'ECONOMY' AND urgency = 'High') AS c2,
         count(*) FILTER (feedback_category = 'Praise/Positive' AND sentiment = 'Positive') AS c3, count(*) AS c4,
         count(*) FILTER (product_category = 'Unknown') AS c5, count(*) FILTER (NOT verified_purchase AND {DATE_FILTER}) AS c6
  FROM joined) t"""),
        "window_stats_many": with_base("SELECT * FROM counts", WINDOWS, window_counts("all_windows")),
    }


def _counts() -> dict[str, str]:
    axis = " ".join(f"WHEN {q(u)} THEN {i + 1}" for i, u in enumerate(tx.URGENCY_AXIS))
    before, after = tx.BANNER_FORMAT.split("%d")
    facets = " UNION ".join(
        [f"SELECT '{c}' AS \"column\", {c} AS value FROM reviews" for c in ("product_category", "quarter")]
        + [f"SELECT '{c}', {c} FROM classifications" for c in ("feedback_category", "sentiment", "urgency")])
    static = ", ".join(
        f"({i}, {q(n)}, {q(t)}, {q(r)}, {q(note)})" for i, (n, t, r, note) in enumerate(tx.PROFILE_COLUMNS))
    return {
        "count_query": with_base(
            "SELECT count(*) AS count FROM joined WHERE sentiment = 'Negative' AND verified_purchase"
            " AND review_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'"),
        "count_query_latest": with_base(
            "SELECT count(*) AS count FROM (SELECT * FROM joined QUALIFY row_number() OVER"
            " (PARTITION BY review_id ORDER BY classified_at DESC) = 1) t WHERE sentiment = 'Negative'"),
        "breakdown_query": with_base(
            "SELECT coalesce(sentiment, 'null') AS sentiment, count(*) AS count FROM joined WHERE product_category = 'ECONOMY' GROUP BY 1"),
        "chart_query": with_base(
            f"SELECT coalesce(feedback_category, 'null') AS feedback_category, count(*) AS count FROM joined WHERE {DATE_FILTER} GROUP BY 1"),
        "aggregated_stats": with_base(
            marginals("picked"), "picked AS (SELECT * FROM joined WHERE sentiment = 'Negative')"),
        "top_themes": with_base(
            "SELECT feedback_category, count(*) AS count FROM joined WHERE sentiment = 'Negative' AND feedback_category IS NOT NULL"
            " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
        "window_stats": with_base(marginals("picked"), f"picked AS (SELECT * FROM joined WHERE {DATE_FILTER})"),
        "dashboard_charts": with_base(
            f"""SELECT CASE dimension WHEN 'total' THEN 'banner' ELSE dimension END AS dimension,
  CAST(CASE dimension WHEN 'total' THEN 0 WHEN 'urgency' THEN (CASE value {axis} END) ELSE
    row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) END AS INT) AS position,
  CASE dimension WHEN 'total' THEN {q(before)} || count || {q(after)} ELSE value END AS value, count
FROM ({marginals("picked")}) m""",
            "picked AS (SELECT * FROM joined WHERE urgency IN ('High', 'Low'))"),
        "coverage": with_base("SELECT row_count, lo AS date_min, hi AS date_max FROM cover"),
        "distinct_values": with_base(facets),
        "schema_profile": with_base(
            f"""SELECT CAST(position AS INT) AS position, s."column", "type",
  CASE "range" WHEN 'data' THEN CAST(lo AS VARCHAR) || ' to ' || CAST(hi AS VARCHAR) ELSE "range" END AS "range", note, value, row_count
FROM (VALUES {static}) AS s(position, "column", "type", "range", note)
LEFT JOIN ({facets} UNION ALL SELECT 'verified_purchase', unnest(['true', 'false'])) f ON f."column" = s."column", cover"""),
        "feedback_cube": with_base(
            "SELECT product_category, feedback_category, sentiment, urgency, quarter, verified_purchase, CAST(CAST(review_date AS DATE) AS VARCHAR) AS review_day,"
            " coalesce(review_date = date_trunc('day', review_date), false) AS at_midnight, count(*) AS n FROM joined GROUP BY ALL"),
        "feedback_cube_maintained": with_base(
            "SELECT product_category, feedback_category, sentiment, urgency, quarter, verified_purchase, CAST(CAST(review_date AS DATE) AS VARCHAR) AS review_day,"
            " coalesce(review_date = date_trunc('day', review_date), false) AS at_midnight, count(*) AS n FROM joined GROUP BY ALL"),
    }


def _specs() -> dict[str, str]:
    types = "list_filter(chart_types, lambda t: list_contains(['bar', 'line', 'pie'], t))"
    kind = [q(s["explanation"]) for s in QUESTIONS]
    return {
        "normalize_specs": with_base(
            f"""SELECT spec_id, CASE WHEN outside THEN 'unsupported' ELSE query_type END AS query_type,
  CASE WHEN d1 IS NULL OR d2 IS NULL THEN date_start ELSE CAST(s2 AS VARCHAR) END AS date_start,
  CASE WHEN d1 IS NULL OR d2 IS NULL THEN date_end ELSE CAST(e2 AS VARCHAR) END AS date_end,
  concat_ws(' ', explanation, CASE WHEN d1 > d2 THEN 'Dates reordered to ' || s || ' to ' || e || '.' END,
    CASE WHEN outside THEN {out_of_range('lo', 'hi')} END,
    CASE WHEN NOT outside AND (s < lo OR e > hi) THEN 'Range clipped to ' || s2 || ' to ' || e2 || '.' END) AS explanation
FROM (SELECT *, CASE WHEN outside THEN s ELSE greatest(s, lo) END AS s2, CASE WHEN outside THEN e ELSE least(e, hi) END AS e2
  FROM (SELECT *, coalesce(e < lo OR s > hi, false) AS outside
    FROM (SELECT *, CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL THEN least(d1, d2) END AS s,
                 CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL THEN greatest(d1, d2) END AS e
      FROM (SELECT specs.*, {plain("date_start")} AS d1, {plain("date_end")} AS d2, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi
            FROM specs, cover) a) b) c) d""", SPECS),
        "validate_specs": with_base(
            " UNION ALL ".join(
                f"SELECT spec_id, '{d}: unknown value ' || {d} AS problem FROM specs WHERE {d} NOT IN"
                f" (SELECT DISTINCT {d} FROM {'reviews' if d == 'product_category' else 'classifications'})"
                for d in tx.FILTER_DIMENSIONS)
            + "".join(
                f" UNION ALL SELECT spec_id, {q(m.split('%s')[0])} || {c} || {q(m.split('%s')[1])} FROM specs"
                f" WHERE query_type = '{t}' AND coalesce({c} NOT IN {in_list(tx.GROUP_COLUMNS)}, true)"
                for t, c, m in (("breakdown", "breakdown_column", tx.BAD_BREAKDOWN_FORMAT), ("chart", "group_by_column", tx.BAD_CHART_FORMAT))),
            SPECS),
        "normalize_chart_types": with_base(
            f"""SELECT spec_id, CASE WHEN len(t) = 0 THEN 'bar' WHEN list_contains(t, 'line') THEN
    CASE WHEN NOT list_contains(t, 'pie') THEN 'bar' WHEN list_position(t, 'pie') < list_position(replace_line, 'bar') THEN 'pie,bar' ELSE 'bar,pie' END
  ELSE array_to_string(t, ',') END AS chart_types, CASE WHEN list_contains(t, 'line') THEN {q(tx.LINE_NOTE)} END AS note
FROM (SELECT spec_id, {types} AS t, list_transform({types}, lambda x: CASE x WHEN 'line' THEN 'bar' ELSE x END) AS replace_line FROM specs) s""",
            SPECS),
        "run_spec": with_base(
            f"""SELECT 1 AS spec_id, 'count' AS kind, {kind[0]} AS explanation, 0 AS position, 'count' AS label, CAST(count(*) AS VARCHAR) AS value,
  NULL AS note, NULL AS chart_types
FROM joined WHERE sentiment = 'Negative' AND {DATE_FILTER}
UNION ALL SELECT 2, 'table', {kind[1]}, CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(feedback_category, 'null')) AS INT),
  coalesce(feedback_category, 'null'), CAST(count(*) AS VARCHAR), NULL, NULL FROM joined WHERE product_category = 'ECONOMY' GROUP BY feedback_category
UNION ALL SELECT 3, 'chart', {kind[2]},
  CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(urgency, 'null')) AS INT), coalesce(urgency, 'null'), CAST(count(*) AS VARCHAR), {q(tx.LINE_NOTE)}, 'bar,pie'
  FROM joined GROUP BY urgency
UNION ALL SELECT 4, 'message', {q(tx.NO_MATCH)}, 0, NULL, NULL, NULL, NULL
UNION ALL SELECT 5, 'message', {q(tx.BAD_BREAKDOWN_FORMAT % "rating")}, 0, NULL, NULL, NULL, NULL
UNION ALL SELECT 6, 'message', {q(tx.NOT_FOUND_FORMAT % "no_such_review")}, 0, NULL, NULL, NULL, NULL
UNION ALL SELECT 7, 'message', {kind[6]}, 0, NULL, NULL, NULL, NULL
UNION ALL SELECT 8, 'summary', {kind[7]}, 0, {q(tx.SUMMARY_LABEL_FORMAT % ("1997-01-01", "1997-06-30"))},
  replace(narrative, 'H1 1997', {q(tx.SUMMARY_LABEL_FORMAT % ("1997-01-01", "1997-06-30"))}), NULL, NULL FROM narratives WHERE window_label = 'H1 1997'
UNION ALL SELECT 8, 'followup', {kind[7]}, CAST(unnest([1, 2, 3]) AS INT), unnest(['1', '2', '3']), unnest({array(tx.FALLBACK_FOLLOWUPS)}), NULL, NULL
UNION ALL SELECT 9, 'message', {q(tx.BAD_DATES_FORMAT % ("1997-01-01", "June"))}, 0, NULL, NULL, NULL, NULL""",
            WINDOWS, window_counts("report_windows"), NARRATIVE),
        "parse_spec_json": with_base(
            f"""SELECT spec_id, problem, CASE WHEN problem IS NOT NULL THEN 'unsupported' WHEN b = 9 THEN 'count' ELSE query_type END AS query_type,
  NULL AS review_id, {", ".join(f"CASE WHEN b < 6 THEN {c} END AS {c}" for c in (
      "breakdown_column", "group_by_column", *tx.FILTER_DIMENSIONS, "verified_purchase", "date_start", "date_end"))},
  CASE WHEN b < 6 THEN array_to_string(chart_types, ',') END AS chart_types,
  CASE WHEN problem IS NOT NULL THEN {q(tx.UNREADABLE_QUESTION)} WHEN b = 9 THEN 'typed' ELSE explanation END AS explanation
FROM (SELECT *, spec_id % 10 AS b, CASE spec_id % 10 WHEN 6 THEN 'not a JSON object' WHEN 7 THEN 'missing explanation' WHEN 8 THEN 'unknown query_type' END AS problem FROM specs) s""",
            SPECS),
    }


def _prompt_lines() -> str:
    return " || chr(10) || ".join(
        f"{q(key.replace('_', ' ') + ': ')} || coalesce(string_agg(value || ': ' || count, ', ' ORDER BY count DESC, value) FILTER (dimension = '{d}'), '')"
        for d, key in STAT_KEYS.items())


def _texts() -> dict[str, str]:
    fields = "feedback_category, sentiment, urgency, reasoning"
    head = [("system", tx.SYSTEM_PROMPT), *few_shot_messages()]
    head_text = "|".join("~".join(p for p in m if p is not None) for m in head)
    opening, closing = tx.REVIEW_PROMPT_FORMAT.split("%s")
    question = f"{q(opening)} || review_text || {q(closing)}"
    model = " ".join(
        f"WHEN {k} THEN {q(c)}" for k, c in ((3, tx.COMPLAINTS[0]), (4, tx.PRAISE)))
    # Position of each question in the generated completions.
    return {
        "classify_rules": "WITH " + TEXTS + "," + rules("text_reviews") + f"\nSELECT review_id, {fields} FROM labelled",
        "classify_rules_reviews": with_base(f"SELECT review_id, {fields} FROM labelled", rules("reviews")),
        "classify_model": "WITH " + TEXTS + f"""
SELECT review_id, CASE k {model} ELSE {q(tx.NO_CONTEXT)} END AS feedback_category, 'Neutral' AS sentiment, 'Low' AS urgency,
  CASE WHEN k IN (0, 2, 5) THEN {q(tx.FALLBACK["reasoning"])} ELSE 'kind ' || k END AS reasoning
FROM (SELECT *, length(review_text) % 7 AS k FROM text_reviews) t""",
        "build_prompts": "WITH " + TEXTS + f"""
SELECT review_id, {len(head) + 1} AS n_messages, md5({q(head_text)} || '|user~' || {question}) AS prompt_md5,
  CAST(length({question}) AS INT) AS question_chars FROM text_reviews""",
        "classification_agreement": "WITH " + TEXTS + "," + rules("text_reviews") + """
SELECT gold_category AS gold, feedback_category AS predicted, count(*) AS count FROM labelled GROUP BY ALL""",
        "reprocess_queue": with_base(
            "SELECT review_id, failed_at FROM (SELECT review_id, max(classified_at) FILTER (failed) AS failed_at,"
            " max(classified_at) FILTER (NOT failed) AS good_at FROM (SELECT *, reasoning = 'rule' AND md5(review_id)[1] = '0' AS failed"
            " FROM classifications) c GROUP BY 1) t WHERE failed_at IS NOT NULL AND (good_at IS NULL OR good_at <= failed_at)"),
        "window_narrative": with_base("SELECT * FROM narratives", WINDOWS, window_counts("all_windows"), NARRATIVE),
        "window_summary_job": with_base(
            f"""SELECT window_label, date_start, date_end, is_valid AND count IS NOT NULL AS success,
  CASE WHEN NOT is_valid THEN message WHEN count IS NULL THEN {q(tx.NO_REVIEWS_IN_RANGE)} END AS error, coalesce(count, 0) AS total_reviews, stats, narrative
FROM overlap LEFT JOIN (SELECT window_label, count FROM counts WHERE dimension = 'total') t USING (window_label)
LEFT JOIN jsons USING (window_label) LEFT JOIN narratives USING (window_label)""",
            WINDOWS, OVERLAP, window_counts("all_windows"), JSONS, NARRATIVE),
        "stats_json": with_base(
            "SELECT window_label, dimension, value, count FROM counts WHERE dimension <> 'complaints_by_product'",
            WINDOWS, window_counts("all_windows")),
        "newest_first_thread": "SELECT * FROM conversations",
        "context_window": """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position, turn,
  CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, coalesce(text, '') AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) t WHERE back <= 3""",
        "query_prompts": with_base(f"""SELECT conv_id, CAST(count(*) + 1 AS INT) AS n_messages, md5({q("system~" + questions.PARSE_PROMPT)} || string_agg('|' || role || '~' || content, '' ORDER BY turn)) AS prompt_md5
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, coalesce(max(role) FILTER (back = 1) OVER (PARTITION BY conv_id), '') AS lastly,
        CASE WHEN back = 1 THEN 'Schema:' || chr(10) || 'rows ' || row_count || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') ELSE coalesce(text, '') END AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) t, cover WHERE back <= 9) u
WHERE lastly = 'user' GROUP BY conv_id"""),
        "summary_prompts": with_base(f"""
SELECT window_label, 'summary' AS task, md5({q("system~" + questions.SUMMARY_PROMPT + "|user~")} || {_prompt_lines()} || chr(10) || 'total: ' || max(count) FILTER (dimension = 'total')) AS prompt_md5
FROM counts GROUP BY 1
UNION ALL SELECT window_label, 'followups', md5({q("system~" + questions.FOLLOWUP_PROMPT + "|user~Summary: ")} || narrative || chr(10) || chr(10) || 'Stats: ' || stats)
FROM overlap JOIN narratives USING (window_label) JOIN jsons USING (window_label) WHERE is_valid""",
            WINDOWS, OVERLAP, window_counts("all_windows"), NARRATIVE, JSONS),
        "parse_followups": f"""SELECT doc_id, CAST(unnest([0, 1, 2]) AS INT) AS position,
  unnest(CASE WHEN doc_id % 5 = 4 THEN {array(tx.FALLBACK_FOLLOWUPS)} ELSE
    ['About ' || source || '?', CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'What next' END, '1. In ' || lang] END) AS question FROM documents""",
        "stream_ingest_classify": with_base(
            f"SELECT review_id, product_category, rating, review_ts AS review_date, md5(review_text) AS text_md5, review_id AS labelled_id, {fields} FROM labelled", rules("reviews")),
    }


def all_oracles() -> dict[str, str]:
    return {
        **_sources(), **_preparation(), **_filters(), **_joins(), **_counts(), **_specs(), **_texts(),
    }
