"""The registered queries in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

import re

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def bm25(clauses: str, key: str = "query_id", k1: str = "1.2", b: str = "0.75") -> str:
    return f"""
    SELECT {key}, doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5))
             * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
    FROM {clauses} JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (doc_id) CROSS JOIN coll
    GROUP BY {key}, doc_id"""


def top(scores: str, size: int, key: str = "query_id") -> str:
    return f"""
    SELECT * FROM (SELECT {key}, doc_id, score, row_number() OVER (
      PARTITION BY {key} ORDER BY score DESC, doc_id)::INT AS rank FROM ({scores}) s) r
    WHERE rank <= {size}"""


def knn(
    p: str, first_ret: int = 10, k: int = 5, min_doc_c: int = 4, top_n: int = 25, lam: float = 0.7
) -> dict[str, str]:
    """Steps of one k-NN expansion; every step's name starts with ``p``."""
    return {
        f"{p}hits": f"SELECT * FROM deep WHERE rank <= {first_ret}",
        f"{p}ht": f"""SELECT query_id, doc_id, term, tf, dl, n_hits FROM {p}hits JOIN post USING (doc_id)
            JOIN lens USING (doc_id) JOIN (SELECT query_id, count(*) AS n_hits FROM {p}hits GROUP BY query_id) USING (query_id)""",
        f"{p}raw": f"""SELECT query_id, doc_id, term, tf * (ln((1 + n_hits) / (1 + hdf)) + 1) AS raw FROM {p}ht
            JOIN (SELECT query_id, term, count(*) AS hdf FROM {p}ht GROUP BY query_id, term) USING (query_id, term)""",
        f"{p}unit": f"""SELECT query_id, doc_id, term, raw / len AS weight FROM {p}raw
            JOIN (SELECT query_id, doc_id, sqrt(sum(raw * raw)) AS len FROM {p}raw GROUP BY query_id, doc_id) USING (query_id, doc_id)""",
        f"{p}dots": f"""SELECT a.query_id, a.doc_id, b.doc_id AS nbr_id, sum(a.weight * b.weight) AS d
            FROM {p}unit a JOIN {p}unit b ON a.query_id = b.query_id AND a.term = b.term GROUP BY ALL""",
        f"{p}allnn": f"""SELECT a.query_id, a.doc_id, b.doc_id AS nbr_id, row_number() OVER (PARTITION BY a.query_id, a.doc_id
              ORDER BY coalesce(round(d, 9), 0) DESC, b.doc_id)::INT AS k
            FROM {p}hits a JOIN {p}hits b ON a.query_id = b.query_id
            LEFT JOIN {p}dots x ON x.query_id = a.query_id AND x.doc_id = a.doc_id AND x.nbr_id = b.doc_id""",
        f"{p}nn": f"SELECT * FROM {p}allnn WHERE k <= {k}",
        f"{p}dom": f"""SELECT query_id, nbr_id AS cluster_id, count(*) AS occurrences FROM {p}nn
            GROUP BY query_id, nbr_id HAVING count(*) > {min_doc_c}""",
        f"{p}mem": f"""SELECT d.query_id, cluster_id, nbr_id AS doc_id, k FROM {p}dom d
            JOIN {p}nn n ON n.query_id = d.query_id AND n.doc_id = d.cluster_id""",
        f"{p}ct": f"""SELECT query_id, cluster_id, term, sum(tf)::BIGINT AS tf
            FROM {p}mem JOIN post USING (doc_id) GROUP BY ALL""",
        f"{p}cl": f"SELECT query_id, cluster_id, sum(tf) AS cdl FROM {p}ct GROUP BY ALL",
        f"{p}cc": f"SELECT query_id, count(*) AS nc, avg(cdl) AS cavg FROM {p}cl GROUP BY query_id",
        f"{p}cdf": f"SELECT query_id, term, count(*) AS cdf FROM {p}ct GROUP BY ALL",
        f"{p}cscore": f"""SELECT query_id, cluster_id, round(sum(boost * ln(1 + (nc - cdf + 0.5) / (cdf + 0.5))
              * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * cdl / cavg))), 6) AS score
            FROM clauses JOIN {p}ct USING (query_id, term) JOIN {p}cdf USING (query_id, term)
            JOIN {p}cl USING (query_id, cluster_id) JOIN {p}cc USING (query_id) GROUP BY ALL""",
        f"{p}best": f"""SELECT query_id, cluster_id, score FROM {p}cscore
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cluster_id) = 1""",
        f"{p}ts": f"""SELECT query_id, cluster_id, term, tf, cdf AS df, round(tf * log10(n / cdf), 6) AS score
            FROM {p}ct JOIN {p}cdf USING (query_id, term) CROSS JOIN coll""",
        f"{p}top": f"""SELECT query_id, term, score, row_number() OVER (
              PARTITION BY query_id ORDER BY score DESC, term)::INT AS rank
            FROM {p}ts JOIN (SELECT query_id, cluster_id FROM {p}best) USING (query_id, cluster_id)
            QUALIFY rank <= {top_n}""",
        f"{p}qe": f"""SELECT query_id, term, boost * CASE WHEN query_id IN (SELECT query_id FROM {p}dom) THEN {lam} ELSE 1 END AS boost FROM clauses
            UNION ALL SELECT query_id, term, 1 - {lam} AS boost FROM {p}top""",
        f"{p}run": top(bm25(f"{p}qe"), 10),
    }


# Settings of the registered grid: first_ret, n_neighbours, min_doc_c, top_n, lambda.
GRID = (
    (10, 5, 4, 10, 0.9),
    (10, 5, 5, 10, 0.7),
    (20, 5, 6, 25, 0.5),
    (20, 3, 50, 25, 0.7),
)

DIFFS = """SELECT m.method, metric, id_q, b.value AS base_value, m.value, round(round(m.value - b.value, 9), 4) AS difference
    FROM long m JOIN (SELECT metric, id_q, value FROM long WHERE method = 'base') b USING (metric, id_q)
    WHERE m.method <> 'base'"""

# Simpson's rule on 2000 steps stands in for the distribution functions.
SIMPSON = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"

STEPS = {
    "tok": f"SELECT doc_id, unnest({TOKENS}) AS term FROM documents",
    "post": "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "lens": "SELECT doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY doc_id",
    "terms": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "coll": "SELECT count(*) AS n, (SELECT sum(tf) FROM post)::DOUBLE / count(*) AS avgdl FROM documents",
    "clauses": f"""SELECT query_id, term, count(*)::DOUBLE AS boost
        FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL""",
    "deep": top(bm25("clauses"), 20),
    "base_run": "SELECT * FROM deep WHERE rank <= 10",
    "qrels": """SELECT item_id AS query_id, d.doc_id, (1 + coalesce(quality, 0))::INT AS grade
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id) WHERE length(b.text) > 0""",
    "judged": """SELECT query_id, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS r,
          sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS idcg
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY query_id""",
    "settings": "SELECT * FROM (VALUES ('base', 1.2::DOUBLE, 0.75::DOUBLE), ('flat', 1.2, 0.0), ('sharp', 0.4, 1.0)) v(method, k1, b)",
    "mclauses": "SELECT * FROM clauses CROSS JOIN settings",
    "runs": top(bm25("mclauses", "method, query_id", "k1", "b").replace("GROUP BY method", "GROUP BY k1, b, method"), 10, "method, query_id"),
    "hitgrades": """SELECT method, query_id, rank, coalesce(grade, 0) AS grade,
          CASE WHEN grade >= 1 THEN 1 ELSE 0 END AS rel FROM runs LEFT JOIN qrels USING (query_id, doc_id)""",
    "evaluated": """SELECT method, query_id,
          CASE WHEN r > 0 THEN ps / r ELSE 0 END AS map, early / 5 AS p_5, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg_10
        FROM (SELECT method, query_id, sum(rel * seen / rank) AS ps, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS early,
                sum(grade / log2(rank + 1)) AS dcg
              FROM (SELECT *, sum(rel) OVER (PARTITION BY method, query_id ORDER BY rank) AS seen FROM hitgrades) GROUP BY ALL)
        JOIN judged USING (query_id)""",
    "methods": """SELECT query_id AS id_q, round(round(map, 9), 4) AS map, round(round(p_5, 9), 4) AS p_5, round(round(ndcg_10, 9), 4) AS ndcg_10, method FROM evaluated""",
    "long": "SELECT method, metric, id_q, value FROM methods UNPIVOT (value FOR metric IN (map, p_5, ndcg_10))",
    "diffs": DIFFS,
    "totals": """SELECT CASE WHEN event_type = 'view' THEN 'base' ELSE event_type END AS method, 'total' AS metric,
          user_id AS id_q, round(sum(value), 2) AS value FROM events GROUP BY ALL""",
    "spending": """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'base' ELSE o_orderpriority END AS method, 'spent' AS metric,
          o_custkey AS id_q, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL""",
    "samples": """SELECT method, metric, id_q, value FROM long UNION ALL SELECT method, metric, id_q, value FROM totals
        UNION ALL SELECT method, metric, id_q, value FROM spending""",
    "spairs": DIFFS.replace("long", "samples").replace("round(round(m.value - b.value, 9), 4) AS difference", "b.value - m.value AS d"),
    "gains": "SELECT method, metric, id_q, base_value, value, round(round(-d, 9), 4) AS g FROM spairs",
    "tsum": "SELECT method, metric, count(*) AS n, avg(d) AS mean_d, stddev_samp(d) AS sd_d, max(greatest(abs(base_value), abs(value))) AS size FROM spairs GROUP BY ALL",
    "tval": "SELECT *, CASE WHEN n >= 2 AND sd_d > size * 1e-12 THEN mean_d / (sd_d / sqrt(n)) END AS t FROM tsum",
    "tp": f"""SELECT method, metric, n, mean_d, sd_d, t, CASE WHEN t IS NOT NULL THEN
          sum({SIMPSON} * pow(cos(th + (pi() / 2 - th) * i / 2000), n - 2)) * (pi() / 2 - th)
          / (sum({SIMPSON} * pow(cos(pi() / 2 * i / 2000), n - 2)) * pi() / 2) END AS p
        FROM (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th FROM tval) CROSS JOIN range(2001) s(i)
        GROUP BY method, metric, n, mean_d, sd_d, t, th""",
    "ranked": """SELECT method, metric, d, rank() OVER w + (count(*) OVER (PARTITION BY method, metric, abs(d)) - 1) / 2 AS rk
        FROM (SELECT method, metric, round(round(d, 9), 4) AS d FROM spairs) WHERE d <> 0
        WINDOW w AS (PARTITION BY method, metric ORDER BY abs(d))""",
    "ranksum": """SELECT method, metric, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS rp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS rm
        FROM ranked GROUP BY ALL""",
    "tiesum": """SELECT method, metric, sum(pow(c, 3) - c) AS ts FROM
        (SELECT method, metric, abs(d) AS a, count(*) AS c FROM ranked GROUP BY ALL) GROUP BY ALL""",
    "zval": """SELECT method, metric, n, rp, rm, (least(rp, rm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ts / 48) AS z
        FROM ranksum JOIN tiesum USING (method, metric)""",
    "wp": f"""SELECT method, metric, coalesce(n, 0) AS n, rp AS rank_sum_plus, rm AS rank_sum_minus, z, p
        FROM (SELECT DISTINCT method, metric FROM spairs) LEFT JOIN
        (SELECT method, metric, n, rp, rm, z, sum({SIMPSON} * exp(-pow(abs(z) + 12 * i / 2000, 2) / 2)) * (12.0 / 2000 / 3) * 2 / sqrt(2 * pi()) AS p
        FROM zval CROSS JOIN range(2001) s(i) GROUP BY ALL) USING (method, metric)""",
    "hit1": """SELECT query_id, term, round(tf * log10(n / df), 6) AS score FROM deep JOIN post USING (doc_id) JOIN terms USING (term)
        CROSS JOIN coll WHERE rank = 1""",
    "hit1top": "SELECT query_id, term FROM hit1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) <= 10",
    "wclauses": """SELECT query_id, term, boost * 0.7 AS boost FROM clauses
        UNION ALL SELECT query_id, term, 1 - 0.7 AS boost FROM hit1top""",
    **knn("k_"),
    **knn("f_", k=3, min_doc_c=6),
    **{
        name: step
        for i, (first_ret, k, c, top_n, lam) in enumerate(GRID, start=1)
        for name, step in knn(f"g{i}_", first_ret, k, c, top_n, lam).items()
    },
    "gruns": " UNION ALL ".join(
        f"SELECT {i} AS config_id, query_id, doc_id, rank FROM g{i}_run" for i in range(1, len(GRID) + 1)
    ),
    "parts": """SELECT item_id AS query_id, CASE WHEN row_number() OVER (ORDER BY item_id) <= 20 THEN 'train'
          WHEN row_number() OVER (ORDER BY item_id DESC) <= 12 THEN 'test' ELSE 'unused' END AS part FROM benchmark""",
    "ghits": """SELECT config_id, query_id, rank, coalesce(grade, 0) AS grade, CASE WHEN grade >= 1 THEN 1 ELSE 0 END AS rel
        FROM gruns JOIN parts USING (query_id) LEFT JOIN qrels USING (query_id, doc_id) WHERE part = 'train'""",
    "gmeans": """SELECT config_id, round(round(avg(CASE WHEN r > 0 THEN ps / r ELSE 0 END), 9), 4) AS map, round(round(avg(early / 5), 9), 4) AS p_5,
          round(round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 9), 4) AS ndcg_10
        FROM (SELECT config_id, query_id, sum(rel * seen / rank) AS ps, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS early,
                sum(grade / log2(rank + 1)) AS dcg
              FROM (SELECT *, sum(rel) OVER (PARTITION BY config_id, query_id ORDER BY rank) AS seen FROM ghits) GROUP BY ALL)
        JOIN judged USING (query_id) GROUP BY config_id""",
    "xhits": """SELECT config_id, query_id, rank, coalesce(grade, 0) AS grade, CASE WHEN grade >= 1 THEN 1 ELSE 0 END AS rel
        FROM gruns JOIN parts USING (query_id) LEFT JOIN qrels USING (query_id, doc_id) WHERE part = 'test'""",
    "xmeans": """SELECT config_id, round(round(avg(CASE WHEN r > 0 THEN ps / r ELSE 0 END), 9), 4) AS map, round(round(avg(early / 5), 9), 4) AS p_5,
          round(round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 9), 4) AS ndcg_10
        FROM (SELECT config_id, query_id, sum(rel * seen / rank) AS ps, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS early,
                sum(grade / log2(rank + 1)) AS dcg
              FROM (SELECT *, sum(rel) OVER (PARTITION BY config_id, query_id ORDER BY rank) AS seen FROM xhits) GROUP BY ALL)
        JOIN judged USING (query_id) GROUP BY config_id""",
    "shortclauses": f"""SELECT query_id, term, count(*)::DOUBLE AS boost
        FROM (SELECT item_id AS query_id, unnest(({TOKENS})[6:9]) AS term FROM benchmark) GROUP BY ALL""",
    # What the growing index holds in the end.
    "gdocs": "SELECT * FROM documents WHERE (doc_id % 7 <> 0 OR doc_id % 21 = 0) AND doc_id % 11 <> 0",
    "gpost": "SELECT doc_id, term, count(*) AS tf FROM tok JOIN (SELECT doc_id FROM gdocs) USING (doc_id) GROUP BY ALL",
    "gterms": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM gpost GROUP BY term",
    "gcoll": "SELECT count(*) AS n, (SELECT sum(tf) FROM gpost)::DOUBLE / count(*) AS avgdl FROM gdocs",
    "gscores": bm25("clauses").replace("terms", "gterms").replace("post", "gpost").replace("coll", "gcoll"),
    # Word vectors: window 3, min_count 2, shift ln 5, 75 components, 7 terms.
    "wtok": f"""SELECT query_id, rank, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos
        FROM (SELECT query_id, rank, {TOKENS} AS tokens FROM deep JOIN documents USING (doc_id) WHERE rank <= 10)""",
    "wpos": """SELECT query_id, rank, term, row_number() OVER (PARTITION BY query_id, rank ORDER BY pos) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS c FROM wtok) WHERE c >= 2""",
    "wnear": """SELECT a.query_id, a.term, b.term AS context, 4 - g AS n FROM wpos a CROSS JOIN (VALUES (1), (2), (3)) v(g)
        JOIN wpos b ON b.query_id = a.query_id AND b.rank = a.rank AND b.p = a.p + g""",
    "wco": """SELECT query_id, term, context, sum(n) AS n FROM (SELECT * FROM wnear UNION ALL SELECT query_id, context, term, n FROM wnear) GROUP BY ALL""",
    "wterm": "SELECT query_id, term, sum(n) AS tn, pow(sum(n), 0.75) AS smooth FROM wco GROUP BY ALL",
    "wall": "SELECT query_id, sum(smooth) AS total FROM wterm GROUP BY ALL",
    "wvec": """SELECT query_id, term, context, weight FROM (
          SELECT c.query_id, c.term, c.context, round(ln(n * total / (t.tn * x.smooth)) - ln(5), 6) AS weight
          FROM wco c JOIN wterm t ON t.query_id = c.query_id AND t.term = c.term JOIN wterm x ON x.query_id = c.query_id AND x.term = c.context
          JOIN wall w ON w.query_id = c.query_id)
        WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY weight DESC, context) <= 75""",
    "wunit": """SELECT v.query_id, v.term, context, weight / sqrt(sum(weight * weight) OVER (PARTITION BY v.query_id, v.term)) AS u,
        c.term IS NOT NULL AS asked FROM wvec v LEFT JOIN clauses c ON c.query_id = v.query_id AND c.term = v.term""",
    "wsim": """SELECT query_id, q_term, term, score, row_number() OVER (PARTITION BY query_id, q_term ORDER BY score DESC, term) AS rank
        FROM (SELECT a.query_id, a.term AS q_term, b.term, round(sum(a.u * b.u), 6) AS score FROM wunit a JOIN wunit b
              ON a.query_id = b.query_id AND a.context = b.context WHERE a.asked AND NOT b.asked GROUP BY ALL) QUALIFY rank <= 7""",
    "wnew": """SELECT query_id, term, score, row_number() OVER (PARTITION BY query_id ORDER BY near, score DESC, term)::INT AS rank
        FROM (SELECT query_id, term, max(score) AS score, min(rank) AS near FROM wsim GROUP BY ALL) QUALIFY rank <= 7""",
    "wqe": "SELECT query_id, term, boost * 0.7 AS boost FROM clauses UNION ALL SELECT query_id, term, (1 - 0.7) * score FROM wnew",
    # Exact signed ranks: chances of all doubled rank sums, one difference after the other.
    "erank": """SELECT method, metric, d, rank() OVER w + (count(*) OVER (PARTITION BY method, metric, abs(d)) - 1) / 2 AS rk,
          row_number() OVER (PARTITION BY method, metric ORDER BY abs(d)) AS i FROM (SELECT method, metric, -difference AS d FROM diffs) WHERE d <> 0
        WINDOW w AS (PARTITION BY method, metric ORDER BY abs(d))""",
    "echance": """SELECT * FROM (WITH RECURSIVE step AS (
          SELECT DISTINCT method, metric, 0::BIGINT AS i, [1.0::DOUBLE] AS c FROM erank
          UNION ALL SELECT s.method, s.metric, s.i + 1, list_transform(range(len(c) + (2 * rk)::BIGINT), lambda k:
              (coalesce(c[k + 1], 0) + CASE WHEN k >= (2 * rk)::BIGINT THEN c[k + 1 - (2 * rk)::BIGINT] ELSE 0 END) / 2)
            FROM step s JOIN erank r ON r.method = s.method AND r.metric = s.metric AND r.i = s.i + 1
        ) SELECT method, metric, arg_max(c, i) AS c FROM step GROUP BY ALL)""",
    "esum": """SELECT method, metric, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS rp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS rm FROM erank GROUP BY ALL""",
    "eties": "SELECT method, metric, sum(pow(k, 3) - k) AS ts FROM (SELECT method, metric, abs(d) AS a, count(*) AS k FROM erank GROUP BY ALL) GROUP BY ALL",
}

VERDICT = "CASE WHEN {p} < 0.05 AND {d} < 0 THEN 'better' WHEN {p} < 0.05 AND {d} > 0 THEN 'worse' ELSE 'no difference' END"

REPORT_VERDICTS = f"""SELECT method, metric, round(tp.p, 6) AS p_t, round(wp.p, 6) AS p_wilcoxon,
    {VERDICT.format(p="tp.p", d="mean_d")} AS verdict_t, {VERDICT.format(p="wp.p", d="(rank_sum_plus - rank_sum_minus)")} AS verdict_wilcoxon
    FROM tp JOIN wp USING (method, metric)"""

FINAL = {
    "tokenize": f"SELECT doc_id, len({TOKENS}) AS n_tokens, array_to_string({TOKENS}, ' ') AS normalized FROM documents",
    "postings_build": "SELECT doc_id, term, tf, dl FROM post JOIN lens USING (doc_id)",
    "term_df": "SELECT term, df, cf FROM terms",
    "tokenize_vectorised": "SELECT term, df, cf FROM terms",
    "doc_length_stats": "SELECT n AS n_docs, (SELECT sum(tf) FROM post)::BIGINT AS n_tokens, round(avgdl, 6) AS avg_length FROM coll",
    "bm25_topk": "SELECT query_id, doc_id, score, rank FROM base_run",
    "bounded_topk": "SELECT query_id, doc_id, score, rank FROM base_run",
    "bounded_short": top(bm25("shortclauses"), 10),
    "feedback_docs": "SELECT query_id, doc_id, score, rank FROM deep",
    "run_export": "SELECT query_id, 'Q0' AS iteration, doc_id, rank, score, 'base' AS tag FROM base_run",
    "run_file_round_trip": "SELECT query_id, 'Q0' AS iteration, doc_id, rank, score, 'base' AS tag FROM base_run",
    "tokenize_by_blanks": r"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS term FROM documents)
        GROUP BY ALL) GROUP BY term""",
    "segment_search": top("SELECT * FROM gscores", 10),
    "segment_terms": "SELECT term, df, cf FROM gterms",
    "weighted_search": top(bm25("wclauses"), 10),
    "precision_at_5": "SELECT query_id, round(p_5, 6) AS p_5 FROM evaluated WHERE method = 'base'",
    "average_precision": "SELECT query_id, round(map, 6) AS ap FROM evaluated WHERE method = 'base'",
    "ndcg_at_10": "SELECT query_id, round(ndcg_10, 6) AS ndcg_10 FROM evaluated WHERE method = 'base'",
    "mean_ap": "SELECT method, round(avg(map), 6) AS map FROM evaluated GROUP BY method",
    "eval_with_all_row": """SELECT method, metric, id_q::VARCHAR AS id_q, value FROM long
        UNION ALL SELECT method, metric, 'all', round(round(avg(value), 9), 4) FROM long GROUP BY method, metric""",
    "metric_file_load": 'SELECT method, metric, id_q AS "id_Q", value, k1, b::DOUBLE AS b FROM long JOIN settings USING (method)',
    "metric_file_find": 'SELECT id_q AS "id_Q", map FROM methods WHERE method = \'base\'',
    "metric_files_combined": 'SELECT id_q AS "id_Q", map, p_5, ndcg_10, method FROM methods',
    "method_table_scan": 'SELECT id_q AS "id_Q", map, p_5, ndcg_10, method FROM methods',
    "metrics_combine": 'SELECT id_q AS "id_Q", map, p_5, ndcg_10, method FROM methods',
    "method_preview": 'SELECT id_q AS "id_Q", map, p_5, ndcg_10, method FROM methods ORDER BY id_q, method LIMIT 5',
    "query_range_filter": 'SELECT id_q AS "id_Q", map FROM methods WHERE method = \'base\' AND id_q BETWEEN 10 AND 29',
    "method_stack": 'SELECT id_q AS "id_Q", map, p_5, ndcg_10, method FROM methods WHERE method IN (\'base\', \'flat\')',
    "method_diff": 'SELECT method, metric, id_q AS "id_Q", base_value, value, difference FROM diffs',
    "method_means": "SELECT method, round(round(avg(map), 9), 4) AS map, round(round(avg(p_5), 9), 4) AS p_5, round(round(avg(ndcg_10), 9), 4) AS ndcg_10 FROM methods GROUP BY method",
    "mean_diff": """SELECT m.method, m.metric, round(round(m.a - b.a, 9), 4) AS mean_difference
        FROM (SELECT method, metric, avg(value) AS a FROM samples GROUP BY ALL) m
        JOIN (SELECT metric, avg(value) AS a FROM samples WHERE method = 'base' GROUP BY ALL) b USING (metric) WHERE m.method <> 'base'""",
    "diff_extremes": """SELECT a.method, a.metric, a.g AS max_difference, a.id_q AS max_id, a.base_value AS max_base_value, a.value AS max_value,
          b.g AS min_difference, b.id_q AS min_id, b.base_value AS min_base_value, b.value AS min_value
        FROM (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY method, metric ORDER BY g DESC, id_q) = 1) a
        JOIN (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY method, metric ORDER BY g, id_q) = 1) b USING (method, metric)""",
    "paired_ttest": "SELECT method, metric, n, round(mean_d, 6) AS mean_d, round(sd_d, 6) AS sd_d, round(t, 6) AS t, round(p, 6) AS p FROM tp",
    "wilcoxon": "SELECT method, metric, n, rank_sum_plus, rank_sum_minus, round(z, 6) AS z, round(p, 6) AS p FROM wp",
    "wilcoxon_exact": """SELECT method, metric, coalesce(n, 0) AS n, rp AS rank_sum_plus, rm AS rank_sum_minus,
          round((least(rp, rm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ts / 48), 6) AS z,
          CASE WHEN n > 0 THEN round(least(1, 2 * list_sum(c[1 : (2 * least(rp, rm))::BIGINT + 1])), 6) END AS p
        FROM (SELECT DISTINCT method, metric FROM diffs) LEFT JOIN (SELECT * FROM esum JOIN eties USING (method, metric) JOIN echance USING (method, metric)) USING (method, metric)""",
    "significance_verdict": REPORT_VERDICTS.replace(
        "SELECT method, metric,", "SELECT method, metric, round(-mean_d, 6) AS mean_difference,"
    ),
    "method_report": f"""SELECT method, metric, n, base_mean, method_mean, mean_difference, max_difference, max_id, min_difference, min_id,
          p_t, p_wilcoxon, verdict_t, verdict_wilcoxon
        FROM (SELECT method, metric, count(*) AS n, round(round(avg(base_value), 9), 4) AS base_mean, round(round(avg(value), 9), 4) AS method_mean FROM spairs GROUP BY ALL)
        JOIN (__mean_diff__) USING (method, metric) JOIN (__diff_extremes__) USING (method, metric)
        JOIN ({REPORT_VERDICTS}) USING (method, metric)""",
    "tfidf_l2": "SELECT query_id, doc_id, term, round(weight, 9) AS weight FROM k_unit",
    "knn_neighbours": "SELECT query_id, doc_id, nbr_id, k FROM k_nn",
    "knn_dominant_docs": "SELECT query_id, cluster_id, occurrences FROM k_dom",
    "cluster_documents": """SELECT query_id, cluster_id, string_agg(text, ' ' ORDER BY k) AS text
        FROM k_mem JOIN documents USING (doc_id) GROUP BY ALL""",
    "best_cluster": "SELECT query_id, cluster_id, score FROM k_best",
    "cluster_term_scores": """SELECT query_id, cluster_id, term, tf, c.df, t.df AS collection_df, score, round(tf * log10(n / t.df), 6) AS collection_score
        FROM k_ts c JOIN terms t USING (term) CROSS JOIN coll""",
    "cluster_top_terms": "SELECT query_id, term, score, rank FROM k_top",
    "qe_term_filter": """SELECT query_id, term, max(score) AS score FROM k_ts
        WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.query_id = k_ts.query_id AND c.term = k_ts.term) GROUP BY ALL""",
    "knn_qe_search": """SELECT 'dominant' AS part, query_id, doc_id, score, rank FROM k_run
        UNION ALL SELECT 'strict', query_id, doc_id, score, rank FROM f_run""",
    "param_grid": f"""SELECT metric, config_id, mean, first_ret, n_neighbours, min_doc_c, top_n, lam
        FROM (SELECT config_id, metric, mean FROM gmeans UNPIVOT (mean FOR metric IN (map, p_5, ndcg_10))
              QUALIFY row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config_id) = 1)
        JOIN (VALUES {", ".join(str((i, *g)) for i, g in enumerate(GRID, start=1))}) v(config_id, first_ret, n_neighbours, min_doc_c, top_n, lam) USING (config_id)""",
    "grid_test_metrics": """SELECT metric, config_id, x.mean AS test_mean
        FROM (SELECT metric, config_id FROM (SELECT config_id, metric, mean FROM gmeans UNPIVOT (mean FOR metric IN (map, p_5, ndcg_10)))
              QUALIFY row_number() OVER (PARTITION BY metric ORDER BY mean DESC, config_id) = 1)
        JOIN (SELECT config_id, metric, mean FROM xmeans UNPIVOT (mean FOR metric IN (map, p_5, ndcg_10))) x USING (config_id, metric)""",
    "query_split": "SELECT query_id, part FROM parts",
    "w2v_vocab": "SELECT query_id, term, sum(tf)::BIGINT AS n FROM k_ht GROUP BY ALL HAVING sum(tf) >= 2",
    "w2v_local_vectors": "SELECT query_id, term, context, weight FROM wvec",
    "w2v_terms": "SELECT query_id, term, score, rank FROM wnew",
    "w2v_qe_search": top(bm25("wqe"), 10),
    "term_similarity": """SELECT probe_id, id, score, rank FROM (
          SELECT p.vec_id AS probe_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[])
              / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 6) AS score,
            row_number() OVER (PARTITION BY p.vec_id ORDER BY score DESC, e.vec_id)::INT AS rank
          FROM embeddings e JOIN embeddings p ON e.vec_id <> p.vec_id WHERE p.vec_id % 100 = 0)
        WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with_steps(_inlined(final)) for name, final in FINAL.items()}


def _inlined(sql: str) -> str:
    return re.sub(r"__(\w+?)__", lambda m: FINAL[m.group(1)], sql)


def _with_steps(final: str) -> str:
    """Prefix the steps that ``final`` uses, directly or through others, in their order."""
    needed: set[str] = set()
    open_texts = [final]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        for name in STEPS.keys() & words - needed:
            needed.add(name)
            open_texts.append(STEPS[name])
    steps = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in STEPS.items() if n in needed)
    return f"WITH {steps} {final}" if steps else final
