"""DuckDB SQL for the catalogue queries. It knows the pack sizes from how the catalogue is made, not from titles."""

from __future__ import annotations

ITEMS = """
WITH rated AS (
  SELECT l_partkey AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY 1
), base AS (
  SELECT p_partkey AS k, p_name AS name, split_part(p_name, ' ', 2) AS noun, p_size + 1 AS s, 2 + p_partkey % 5 AS packs, p_size + 2 AS pieces, p_partkey % 12 AS t,
         'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS parent_asin, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS list_price, CAST(p_size AS BIGINT) AS ps,
         CAST(10 + floor(4.0 * cents / n) AS BIGINT) AS tenths, n AS lines
  FROM part JOIN rated ON p_partkey = rated.k
), raw AS (
  SELECT *, CASE WHEN k % 97 = 0 THEN '  ' WHEN t = 0 THEN name || ', ' || s || ' oz' WHEN t = 1 THEN name || ' ' || packs || ' x ' || s || ' ml' WHEN t = 2 THEN name || ', ' || pieces || ' count'
              WHEN t = 3 THEN name || ' (pack of ' || packs || ')' WHEN t = 4 THEN name || ' kit, ' || s || ' oz' WHEN t = 5 THEN name || ' holder, ' || s || ' oz mug'
              WHEN t = 6 THEN name || ' ' || s || ' oz and ' || (3 * s) || ' oz' WHEN t = 7 THEN name || 's ' || s || ' oz' WHEN t = 8 THEN name || ', ' || s || ' oz, ' || pieces || ' count'
              WHEN t = 9 THEN name || ' refill' WHEN t = 10 THEN name || ' ' || s || ' oz' ELSE name END AS title,
         CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 29 = 0 THEN 'dash' WHEN k % 31 = 0 THEN 'from_range' WHEN k % 37 = 0 THEN 'non_positive' END AS why,
         CAST(tenths AS DOUBLE) / 10 AS average_rating,
         CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 0 ELSE lines * CASE WHEN k % 7 = 0 THEN 20 ELSE 1 END END AS rating_number
  FROM base
), items AS (
  SELECT *, CASE WHEN why IS NULL THEN list_price END AS price, noun = 'plate' AS holds FROM raw WHERE k % 97 <> 0
), priced AS (
  SELECT *, name AS query FROM items WHERE price IS NOT NULL
)"""

PRIORS = """, pool AS (
  SELECT count(*) FILTER (rating_number > 0) AS n_rated, CAST(sum(tenths) FILTER (rating_number > 0) AS DOUBLE) / 10 / count(*) FILTER (rating_number > 0) AS C_simple,
         CAST(sum(tenths * rating_number) FILTER (rating_number > 0) AS DOUBLE) / 10 / CAST(sum(rating_number) AS DOUBLE) AS C_weighted,
         quantile_cont(rating_number, 0.5) FILTER (rating_number > 0) AS m_median
  FROM priced
)"""


def _car(r: str = "average_rating", v: str = "rating_number", c: str = "C", m: str = "m") -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = 0 THEN {c} ELSE (CAST({v} AS DOUBLE) / ({v} + {m})) * {r} + ({m} / ({v} + {m})) * {c} END"


def _set_priors(source: str = "priced", by: str = "query") -> str:
    return f""", own AS (
  SELECT {by} AS query, count(*) FILTER (rating_number > 0) AS n_rated, CAST(sum(tenths) FILTER (rating_number > 0) AS DOUBLE) / 10 / count(*) FILTER (rating_number > 0) AS c1,
         CAST(quantile_cont(rating_number, 0.5) FILTER (rating_number > 0) AS DOUBLE) AS m1
  FROM {source} GROUP BY 1
), priors AS (
  SELECT query, CASE WHEN n_rated >= 30 THEN c1 ELSE CAST(4.25 AS DOUBLE) END AS C, CASE WHEN n_rated >= 30 THEN m1 ELSE CAST(50 AS DOUBLE) END AS m,
         CASE WHEN n_rated >= 30 THEN 'candidate_set' ELSE 'fallback' END AS source, n_rated, n_rated < 30 AS flagged
  FROM own
)"""


ORDER = "car DESC NULLS LAST, coalesce(rating_number, 0) DESC, parent_asin"
SWEEP = (
    ITEMS
    + PRIORS
    + f""", grid AS (
  SELECT 'simple C, m=' || m AS combo, C_simple AS C, CAST(m AS DOUBLE) AS m FROM pool, (VALUES (25), (50), (120), (500)) v(m)
  UNION ALL SELECT 'count-weighted C, m=' || m, C_weighted, CAST(m AS DOUBLE) FROM pool, (VALUES (25), (50), (120), (500)) v(m)
), cars AS (SELECT combo, parent_asin, average_rating, rating_number, {_car()} AS car FROM priced, grid
), tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY {ORDER}) AS rank FROM cars) WHERE rank <= 20
), stars AS (SELECT * FROM priced ORDER BY average_rating DESC NULLS LAST, rating_number DESC NULLS LAST, parent_asin LIMIT 20)"""
)

#: What each template comes to, by how it was made; a plate is a container.
PACKS = """, packs AS (
  SELECT *, CASE WHEN t = 4 THEN 'title_is_kit' WHEN t = 3 AND pieces % packs <> 0 THEN 'sources_disagree' WHEN t = 5 THEN 'no_size_found' WHEN t = 6 AND NOT holds THEN 'title_conflicting_weight'
              WHEN t = 8 AND NOT holds THEN 'title_size_count_ambiguous' WHEN t = 10 AND NOT holds THEN 'sources_disagree' WHEN t = 11 OR t = 9 AND holds THEN 'only_weak_sources'
              WHEN holds AND t IN (0, 1, 6, 7, 10) THEN 'no_size_found' END AS flag
  FROM priced
), sized AS (
  SELECT *, CASE WHEN flag IS NULL THEN CASE WHEN t IN (2, 3, 8) THEN 'count' WHEN t = 1 THEN 'volume' ELSE 'weight' END END AS dimension,
         CASE WHEN flag IS NULL THEN CASE WHEN t IN (2, 3, 8) THEN 'ct' WHEN t = 1 THEN 'ml' WHEN t = 9 THEN 'lb' ELSE 'oz' END END AS punit,
         CASE WHEN flag IS NULL THEN CASE WHEN t = 1 THEN CAST(packs AS DOUBLE) ELSE 1.0 END END AS pcount, CASE WHEN flag IS NULL THEN CASE WHEN t IN (2, 3, 8) THEN CAST(pieces AS DOUBLE) ELSE CAST(s AS DOUBLE) END END AS psize
  FROM packs
), full_packs AS (
  SELECT *, pcount * psize * CASE punit WHEN 'oz' THEN CAST(28.349523125 AS DOUBLE) WHEN 'lb' THEN CAST(453.59237 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS total_base FROM sized
)"""

SCORED = (
    ITEMS
    + PACKS
    + _set_priors("full_packs", "noun")
    + f""", scored AS (
  SELECT f.* EXCLUDE (query), p.query, p.C, p.m, {_car()} AS car,
         total_base / CASE dimension WHEN 'weight' THEN CAST(28.349523125 AS DOUBLE) WHEN 'volume' THEN CAST(29.5735295625 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS total,
         CASE dimension WHEN 'weight' THEN 'oz' WHEN 'volume' THEN 'fl oz' WHEN 'count' THEN 'ct' END AS unit
  FROM full_packs f JOIN priors p ON f.noun = p.query
), ups AS (SELECT *, price / total AS unit_price FROM scored)"""
)
COHERENCE = """, dims AS (
  SELECT query, dimension, count(*) AS n, quantile_cont(unit_price, 0.9) AS p90, quantile_cont(unit_price, 0.1) AS p10 FROM ups WHERE unit_price IS NOT NULL GROUP BY 1, 2
), largest AS (
  SELECT *, sum(n) OVER (PARTITION BY query) AS extracted,
         row_number() OVER (PARTITION BY query ORDER BY n DESC, CASE dimension WHEN 'count' THEN 3 WHEN 'volume' THEN 2 ELSE 1 END DESC) AS place FROM dims
), axes AS (
  SELECT q.query, dimension, coalesce(n, 0) AS n, CAST(coalesce(extracted, 0) AS BIGINT) AS extracted, CAST(n AS DOUBLE) / CAST(extracted AS DOUBLE) AS share, p90 / p10 AS spread,
         CASE WHEN coalesce(n, 0) < 30 THEN 'too_few_extractions' WHEN CAST(n AS DOUBLE) / CAST(extracted AS DOUBLE) < 0.8 THEN 'no_dominant_dimension'
              WHEN dimension = 'count' AND p90 / p10 > 10 THEN 'count_spread' END AS reason
  FROM (SELECT DISTINCT query FROM ups) q LEFT JOIN (SELECT * FROM largest WHERE place = 1) l ON q.query = l.query
)"""
GUARDED = (
    SCORED
    + """, sets AS (SELECT * REPLACE (query || '/' || dimension AS query) FROM ups WHERE car IS NOT NULL AND unit_price IS NOT NULL
), mids AS (SELECT query, quantile_cont(unit_price, 0.5) AS up, quantile_cont(total, 0.5) AS tot FROM sets GROUP BY 1
), guarded AS (
  SELECT s.*, CASE WHEN unit_price / up > 10 OR up / unit_price > 10 THEN 'unit_price_far_from_median' WHEN total / tot > 10 OR tot / total > 10 THEN 'total_size_far_from_median' END AS guard_reason
  FROM sets s JOIN mids USING (query)
), fair AS (SELECT * FROM guarded WHERE guard_reason IS NULL
), cuts AS (SELECT query, quantile_cont(car, 0.5) AS cm, quantile_cont(unit_price, 0.5) AS um FROM fair GROUP BY 1
), placed AS (
  SELECT g.*, CASE WHEN guard_reason IS NULL THEN CASE WHEN car >= cm THEN 'high_car' ELSE 'low_car' END || CASE WHEN unit_price < um THEN '_low_price' ELSE '_high_price' END END AS quadrant
  FROM guarded g JOIN cuts USING (query)
)"""
)


def _wilson(k: str, n: str) -> tuple[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    z2 = "CAST(3.8416 AS DOUBLE)"
    centre, scale = f"({k} / {n} + {z2} / (2 * {n}))", f"(1 + {z2} / {n})"
    half = f"CAST(1.96 AS DOUBLE) * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z2} / (4 * {n} * {n}))"
    return f"round(({centre} - {half}) / {scale}, 6)", f"round(({centre} + {half}) / {scale}, 6)"


def _phrase(title: str, words: str) -> str:
    return f"regexp_matches({title}, '(^|[^a-z0-9]){words}([^a-z0-9]|$)', 'i')"


_MATCHES = {
    "gear": ("gears?", ("holder", "kit", r"pack[\s\-]+of")),
    "widgets": ("widgets?", ("holder", "kit", "refill")),
    "small ring": (r"small[\s\-]+rings?", ("holder", "kit", "count")),
    "hot plate": (r"hot[\s\-]+plates?", ("holder", "kit")),
    "anvil kit": (r"anvil[\s\-]+kits?", ("holder", "kit")),
    "red gizmo": (r"red[\s\-]+gizmos?", ("holder", "kit")),
}
_SHOWN = {r"pack[\s\-]+of": "pack of"}
_LOST = {"oz gear": ("oz", "gear"), "count rod": ("count", "rod"), "mug holder": ("mug", "holder"), "pack plate": ("pack", "plate")}


def _matches() -> str:
    parts = []
    for query, (phrase, terms) in _MATCHES.items():
        hits = " || ".join(f"CASE WHEN {_phrase('title', t)} THEN '|{_SHOWN.get(t, t)}' ELSE '' END" for t in terms)
        parts.append(f"SELECT '{query}' AS query, parent_asin, substr({hits}, 2) AS hits FROM priced WHERE {_phrase('title', phrase)}")
    return ", matches AS (" + " UNION ALL ".join(parts) + ")"


def _lost() -> str:
    both = lambda a, b: f"regexp_matches(title, '\\b{a}\\b', 'i') AND regexp_matches(title, '\\b{b}\\b', 'i')"
    parts = [f"SELECT '{q}' AS query, parent_asin, k FROM priced WHERE {both(a, b)} AND NOT {_phrase('title', rf'{a}[\s\-]+{b}s?')}" for q, (a, b) in _LOST.items()]
    return ", lost AS (" + " UNION ALL ".join(parts) + ")"


_VERDICTS = """, audit AS (
  SELECT k AS audit_id, CASE WHEN k % 10 = 9 THEN 'na' WHEN t = 4 THEN 'none' ELSE 'size' END AS truth_kind, CASE WHEN t IN (4, 6) THEN 'abstained' WHEN k % 10 = 9 THEN 'wrong' ELSE 'correct' END AS verdict
  FROM priced WHERE t IN (0, 1, 2, 4, 6, 7) AND NOT holds
)"""
_PERCENTILES = ((1, 0.01), (5, 0.05), (10, 0.1), (25, 0.25), (50, 0.5), (75, 0.75), (90, 0.9), (95, 0.95), (99, 0.99))


def _score() -> str:
    low, high = _wilson("count(*) FILTER (verdict = 'correct')", "count(*) FILTER (verdict <> 'abstained')")
    low_na, high_na = _wilson("count(*) FILTER (verdict = 'correct' AND truth_kind <> 'na')", "count(*) FILTER (verdict <> 'abstained' AND truth_kind <> 'na')")
    n, right = "count(*) FILTER (verdict <> 'abstained')", "count(*) FILTER (verdict = 'correct')"
    n_na, right_na = "count(*) FILTER (verdict <> 'abstained' AND truth_kind <> 'na')", "count(*) FILTER (verdict = 'correct' AND truth_kind <> 'na')"
    share = lambda a, b: f"round(CAST({a} AS DOUBLE) / {b}, 6)"
    return f"""SELECT count(*) AS n_labelled, {n} AS n_returned, count(*) FILTER (truth_kind = 'size') AS truth_size, count(*) FILTER (truth_kind = 'none') AS truth_none,
      count(*) FILTER (truth_kind = 'na') AS truth_na, {n} AS returned_all, {right} AS correct_all, {n_na} AS returned_no_na, {right_na} AS correct_no_na, {n} AS returned_expressible,
      {right} AS correct_expressible, {right} AS exact_matches, count(*) FILTER (truth_kind = 'size' AND verdict = 'abstained') AS labelled_but_abstained,
      count(*) FILTER (truth_kind = 'none' AND verdict = 'wrong') AS returned_where_none, {share(n, 'count(*)')} AS coverage, {share(right, n)} AS precision_all, {low} AS low_all, {high} AS high_all,
      {share(right_na, n_na)} AS precision_no_na, {low_na} AS low_no_na, {high_na} AS high_no_na, {share(right, n)} AS precision_expressible, {low} AS low_expressible, {high} AS high_expressible,
      CAST({right} AS DOUBLE) / {n} >= 0.9 AS passes_guardrail FROM audit"""


def oracle_sql() -> dict[str, str]:
    low_k, high_k = _wilson("count(*) FILTER (o_orderstatus = 'F')", "count(*)")
    low_q, high_q = _wilson("count(*) FILTER (quality = 1)", "count(*)")
    low_s, high_s = _wilson("count(*) FILTER (toxic = 0 AND quality = 1)", "count(*) FILTER (toxic = 0)")
    price = "CASE WHEN why = 'non_positive' THEN 0 WHEN why IS NULL THEN list_price END"
    percentiles = lambda x: ", ".join(f"round(quantile_cont({x}, {p}), 6) AS p{k}" for k, p in _PERCENTILES)
    bins = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip((0, 5, 10, 15, 20, 30, 50, 100, 200, 500), (5, 10, 15, 20, 30, 50, 100, 200, 500, "1e300"), strict=True)))
    sets = ITEMS + _set_priors()
    return {
        "car_topk_by_name": sets
        + f""", cars AS (SELECT priced.*, C, m, source, {_car()} AS car FROM priced JOIN priors USING (query)), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {ORDER}) AS rank FROM cars)
        SELECT query, CAST(rank AS INTEGER) AS rank, parent_asin, round(car, 6) AS car, source FROM ranked WHERE rank <= 5""",
        "priors_with_fallback": sets + " SELECT query, round(C, 6) AS C, round(m, 6) AS m, source, n_rated, flagged FROM priors",
        "pool_priors": ITEMS + PRIORS + " SELECT n_rated, round(C_simple, 6) AS C_simple, round(C_weighted, 6) AS C_weighted, round(m_median, 6) AS m_median FROM pool",
        "car_sensitivity_top": SWEEP + " SELECT combo, CAST(rank AS INTEGER) AS rank, parent_asin, round(car, 6) AS car FROM tops",
        "car_sensitivity_overlap": SWEEP
        + " SELECT a.combo AS a, b.combo AS b, (SELECT count(*) FROM tops x JOIN tops y USING (parent_asin) WHERE x.combo = a.combo AND y.combo = b.combo) AS shared FROM grid a, grid b",
        "distinct_resolution": SWEEP
        + """ SELECT combo, count(DISTINCT round(car, 9)) AS distinct_car, count(DISTINCT round(car, 2)) AS distinct_car_2dp, (SELECT count(DISTINCT average_rating) FROM priced) AS distinct_stars,
        (SELECT count(*) FROM (SELECT DISTINCT average_rating, rating_number FROM priced)) AS distinct_pairs FROM cars GROUP BY 1""",
        "star_sort_top": SWEEP + " SELECT parent_asin, average_rating, rating_number FROM stars",
        "star_sort_overlap": SWEEP
        + """ SELECT combo, count(*) FILTER (parent_asin IN (SELECT parent_asin FROM stars)) AS shared,
        (SELECT list_sort(list(rating_number) FILTER (rating_number IS NOT NULL))[CAST(floor(count(*) / 2) AS INTEGER) + 1] FROM stars) AS upper_median_count FROM tops GROUP BY 1""",
        "rank_table": SWEEP
        + """, cells AS (SELECT p.parent_asin, g.combo, t.rank FROM (SELECT DISTINCT parent_asin FROM tops) p CROSS JOIN grid g LEFT JOIN tops t ON t.parent_asin = p.parent_asin AND t.combo = g.combo),
        placed AS (SELECT parent_asin, row_number() OVER (ORDER BY min(coalesce(rank, 999)) * 100 + CAST(sum(coalesce(rank, 99)) AS DOUBLE) / 100, parent_asin) AS place FROM cells GROUP BY 1)
        SELECT CAST(place AS INTEGER) AS place, parent_asin, combo, CAST(rank AS INTEGER) AS rank FROM cells JOIN placed USING (parent_asin)""",
        "profile_price": ITEMS
        + f""", p AS (SELECT *, {price} AS x FROM raw), above AS (SELECT *, CASE WHEN x > 0 THEN x END AS y FROM p)
        SELECT count(*) AS n_rows, CAST(count(*) - count(DISTINCT parent_asin) AS BIGINT) AS duplicate_ids, round(100.0 * avg(CASE WHEN coalesce(why, '') <> 'missing' THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS pct_non_null,
        round(100.0 * avg(CASE WHEN x IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS pct_numeric, count(*) FILTER (x <= 0) AS non_positive, count(y) AS n, round(avg(y), 2) AS mean, round(min(y), 6) AS min,
        {percentiles('y')}, round(max(y), 6) AS max FROM above""",
        "profile_rating": ITEMS
        + f""", r AS (SELECT *, CASE WHEN rating_number >= 1 THEN rating_number END AS v FROM raw)
        SELECT CAST(100 AS DOUBLE) AS pct_rating, CAST(0 AS BIGINT) AS odd_ratings, CAST(0 AS BIGINT) AS out_of_range, round(100.0 * avg(CASE WHEN rating_number IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS pct_count,
        CAST(0 AS BIGINT) AS odd_counts, count(*) FILTER (rating_number = 0) AS zero_counts, round(100.0 * avg(CASE WHEN rating_number >= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 2) AS pct_count_ge_1, count(v) AS n_rated,
        round(CAST(sum(tenths) FILTER (v IS NOT NULL) AS DOUBLE) / 10 / count(v), 4) AS C_simple, round(CAST(sum(tenths * v) AS DOUBLE) / 10 / CAST(sum(v) AS DOUBLE), 4) AS C_weighted,
        round(quantile_cont(v, 0.5), 6) AS m_median, {percentiles('v')} FROM r""",
        "price_histogram": ITEMS
        + f""", bins AS (SELECT * FROM (VALUES {bins}) b(bin, low, high)) SELECT bin, count(x) AS n FROM bins LEFT JOIN (SELECT {price} AS x FROM raw) ON x > 0 AND x >= low AND x < high GROUP BY 1""",
        "price_texts": ITEMS + """ SELECT CASE why WHEN 'dash' THEN '"—"' ELSE '"from $8.00"' END AS price_text, count(*) AS n FROM raw WHERE why IN ('dash', 'from_range') GROUP BY 1""",
        "price_null_reasons": ITEMS + " SELECT why AS price_null_reason, count(*) AS n FROM items WHERE why IS NOT NULL GROUP BY 1",
        "load_report": ITEMS
        + """ SELECT (SELECT count(*) FROM raw) AS rows_read, count(*) AS rows_loaded, (SELECT count(*) FROM raw WHERE k % 97 = 0) AS empty_titles, CAST(0 AS BIGINT) AS malformed, count(price) AS priced,
        count(*) FILTER (why = 'missing') AS price_missing, count(*) FILTER (why = 'dash') AS price_dash, count(*) FILTER (why = 'from_range') AS price_from_range,
        count(*) FILTER (why = 'non_positive') AS price_non_positive FROM items""",
        "malformed_rows": ITEMS
        + """, e AS (SELECT parent_asin, list_filter([CASE WHEN k % 127 <> 6 AND k % 131 = 7 THEN 'details: absent in the source or bad JSON' END,
          CASE WHEN k % 101 = 1 THEN CASE WHEN why IN ('dash', 'from_range') THEN 'price: bad JSON' ELSE 'price: unrecognised' END END,
          CASE WHEN k % 103 <> 2 AND k % 107 = 3 THEN 'average_rating: not a number' END, CASE WHEN k % 103 = 2 THEN 'average_rating: outside 1 to 5' END,
          CASE WHEN k % 109 <> 4 AND k % 113 = 5 THEN 'rating_number: not a whole number' END, CASE WHEN k % 109 = 4 THEN 'rating_number: negative or too large' END,
          CASE WHEN k % 127 = 6 THEN 'details: not an object' END], lambda x: x IS NOT NULL) AS l FROM items)
        SELECT parent_asin, array_to_string(l, '; ') AS errors FROM e WHERE len(l) > 0""",
        "json_props_decode": "SELECT event_id, 'integer' AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events",
        "detail_projection": ITEMS
        + """ SELECT parent_asin, CASE t WHEN 7 THEN s || ' Ounces' WHEN 9 THEN s || ' Pounds' WHEN 10 THEN (2 * ps + 3) || ' Pounds' ELSE '' END AS size, CASE WHEN t = 3 THEN pieces || ' Count' ELSE '' END AS unit_count,
        CASE WHEN t = 11 THEN CAST(packs AS VARCHAR) ELSE '' END AS number_of_items, CASE WHEN t = 9 THEN CAST(packs AS VARCHAR) ELSE '' END AS item_package_quantity FROM items""",
        "phrase_match": ITEMS + _matches() + " SELECT query, parent_asin, hits = '' AS kept FROM matches",
        "exclusion_hits": ITEMS + _matches() + " SELECT query, parent_asin, hits FROM matches WHERE hits <> ''",
        "adjacency_lost": ITEMS + _lost() + " SELECT query, parent_asin FROM lost",
        "license_phrase_match": f"SELECT 'mit license' AS query, doc_id FROM documents WHERE {_phrase('text', r'mit[\s\-]+licenses?')}",
        "packsize_extract": ITEMS
        + PACKS
        + """ SELECT parent_asin, pcount AS count, psize AS size, punit AS unit, dimension, round(total_base, 6) AS total_base,
        CASE WHEN flag IS NOT NULL THEN '' WHEN t = 3 THEN 'unit_count' WHEN t = 7 THEN 'size_field|title' WHEN t = 9 THEN 'size_field' ELSE 'title' END AS sources,
        CAST(CASE WHEN flag IN ('title_is_kit', 'no_size_found') THEN 0 WHEN flag = 'only_weak_sources' THEN 0.4 WHEN flag = 'title_size_count_ambiguous' THEN 0.6 WHEN flag IS NOT NULL THEN 0.3
             WHEN t = 7 THEN 0.95 WHEN t IN (3, 9) THEN 0.75 ELSE 0.8 END AS DOUBLE) AS confidence, flag FROM full_packs""",
        "packsize_coverage": ITEMS + PACKS + " SELECT dimension, flag, count(*) AS n FROM full_packs GROUP BY 1, 2",
        "packsize_verdicts": ITEMS + _VERDICTS + " SELECT audit_id, truth_kind, verdict, verdict = 'correct' AS exact FROM audit",
        "packsize_score": ITEMS + _VERDICTS + " " + _score(),
        "audit_by_lang": f"""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (toxic = 0) AS n_sure, count(*) FILTER (toxic = 0 AND quality = 1) AS yes_sure,
        round(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*), 6) AS share, {low_q} AS low, {high_q} AS high FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
        "recall_loss": ITEMS
        + _lost()
        + """ SELECT query, count(*) FILTER (k % 3 = 0) AS n, count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS yes, count(*) AS group_size,
        round(CAST(count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS DOUBLE) / count(*) FILTER (k % 3 = 0) * count(*), 6) AS lost FROM lost GROUP BY 1 HAVING count(*) FILTER (k % 3 = 0) > 0""",
        "precision_wilson": f"SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, {low_k} AS low, {high_k} AS high FROM orders GROUP BY 1",
        "unit_price_axis": SCORED + " SELECT parent_asin, dimension, unit, round(total, 6) AS total, round(unit_price, 6) AS unit_price FROM ups",
        "coherence": SCORED + COHERENCE + " SELECT query, dimension, n, extracted, round(share, 6) AS share, round(spread, 6) AS spread, reason IS NULL AS has_axis, reason FROM axes",
        "two_axis": SCORED + COHERENCE + " SELECT u.query, parent_asin FROM ups u JOIN axes a ON u.query = a.query AND u.dimension = a.dimension WHERE reason IS NULL AND car IS NOT NULL AND unit_price IS NOT NULL",
        "guard_flags": GUARDED + " SELECT query, parent_asin, guard_reason IS NOT NULL AS flagged, guard_reason FROM guarded",
        "quadrants": GUARDED + " SELECT query, parent_asin, quadrant FROM placed",
        "off_diagonal": GUARDED
        + """, r AS (SELECT query, parent_asin, percent_rank() OVER (PARTITION BY query ORDER BY car) AS cr, percent_rank() OVER (PARTITION BY query ORDER BY unit_price) AS pr FROM fair)
        SELECT query, parent_asin, round(cr, 6) AS car_rank, round(pr, 6) AS price_rank,
        (cr >= CAST(2 AS DOUBLE) / 3 AND pr <= CAST(1 AS DOUBLE) / 3) OR (cr <= CAST(1 AS DOUBLE) / 3 AND pr >= CAST(2 AS DOUBLE) / 3) AS off_diagonal FROM r""",
        "axis_spearman": GUARDED
        + """, r AS (SELECT query, rank() OVER (PARTITION BY query ORDER BY car) + (count(*) OVER (PARTITION BY query, car) - 1) / CAST(2 AS DOUBLE) AS a,
        rank() OVER (PARTITION BY query ORDER BY unit_price) + (count(*) OVER (PARTITION BY query, unit_price) - 1) / CAST(2 AS DOUBLE) AS b FROM fair)
        SELECT query, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""",
        "star_sort_landing": GUARDED
        + """, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY average_rating DESC NULLS LAST, rating_number DESC NULLS LAST, parent_asin) AS star_rank FROM placed)
        SELECT query, CAST(star_rank AS INTEGER) AS star_rank, parent_asin, quadrant FROM o WHERE star_rank <= 10""",
        "explanations": GUARDED
        + """ SELECT query, parent_asin, printf('%s has a credibility-adjusted rating of %.2f from %d ratings and costs %.2f per %s.', title, round(round(car, 6), 2), coalesce(rating_number, 0), round(round(unit_price, 6), 2), unit) AS explanation FROM guarded""",
        "packsize_pool": ITEMS + PACKS + " SELECT count(*) AS n_items, count(dimension) AS extracted, round(CAST(count(dimension) AS DOUBLE) / count(*), 6) AS coverage FROM full_packs",
        "audit_without_unsure": f"""SELECT source, count(*) FILTER (toxic = 0) AS n_sure, count(*) FILTER (toxic = 0 AND quality = 1) AS yes_sure,
        round(CAST(count(*) FILTER (toxic = 0 AND quality = 1) AS DOUBLE) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS share_sure, {low_s} AS low_sure, {high_s} AS high_sure FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
        "rated_share": ITEMS + " SELECT count(*) AS n, count(*) FILTER (rating_number > 0) AS n_rated FROM items",
    }
