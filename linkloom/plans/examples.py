"""Query texts on links, neighbours and training examples; same form as in ``registry``."""

CHUNKS = (
    "negs AS (SELECT midx, eidx, affinity, CAST(floor((row_number() OVER (PARTITION BY midx ORDER BY rank) - 1) / 4.0) AS BIGINT) AS chunk FROM {scored} WHERE eidx <> gold), "
    "ex AS (SELECT midx, chunk, eidx, affinity, 0 AS label FROM negs UNION ALL SELECT c.midx, c.chunk, s.eidx, s.affinity, 1 AS label FROM (SELECT DISTINCT midx, chunk FROM negs) c JOIN {scored} s ON s.midx = c.midx AND s.eidx = s.gold)"
)
OWN = "own AS (SELECT midx, eidx, gold, affinity FROM {cand} WHERE rank = 1)"
NEAR = "near AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY affinity DESC, b) AS r FROM {ends}) x WHERE r <= 5)"
SHARE = "round(avg(CASE WHEN {} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)"

TEXTS = {
    "a1_document_members": "SELECT doc, midx, CAST(row_number() OVER (PARTITION BY doc ORDER BY midx) - 1 AS BIGINT) AS place FROM {men}",
    "a2_gold_members": "SELECT gold AS eidx, midx, CAST(row_number() OVER (PARTITION BY gold ORDER BY midx) - 1 AS BIGINT) AS place FROM {men}",
    "a19_neighbour_recall": f"WITH {OWN}, {NEAR}, ext AS (SELECT DISTINCT o.midx FROM own o JOIN near n ON n.a = o.midx JOIN own l ON l.midx = n.b WHERE o.eidx <> o.gold AND l.eidx = o.gold AND l.affinity > o.affinity) "
    f"SELECT {SHARE.format('o.eidx = o.gold')} AS accuracy, {SHARE.format('o.eidx = o.gold OR e.midx IS NOT NULL')} AS recall FROM own o LEFT JOIN ext e ON e.midx = o.midx",
    "a20_chunked_accuracy": f"WITH {CHUNKS}, best AS (SELECT midx, label FROM (SELECT midx, label, row_number() OVER (PARTITION BY midx, chunk ORDER BY affinity DESC, eidx) AS r FROM ex) x WHERE r = 1), "
    f"per AS (SELECT midx, min(label) AS hit FROM best GROUP BY midx) SELECT {SHARE.format('hit = 1')} AS accuracy, count(*) AS mentions FROM per",
    "a22_gold_cluster_recall": f"WITH {OWN}, per AS (SELECT gold, CAST(count(*) AS DOUBLE) AS n, max(CASE WHEN eidx = gold THEN 1 ELSE 0 END) AS hit FROM own GROUP BY gold) SELECT round(sum(n * hit) / sum(n), 6) AS recall, count(*) AS clusters FROM per",
    "a23_gold_cluster_accuracy": f"WITH {OWN}, best AS (SELECT gold, eidx, n FROM (SELECT gold, eidx, CAST(count(*) OVER (PARTITION BY gold) AS DOUBLE) AS n, row_number() OVER (PARTITION BY gold ORDER BY affinity DESC, midx) AS r FROM own) x WHERE r = 1) SELECT round(sum(CASE WHEN eidx = gold THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM best",
    "b5_threshold_pairs": "WITH n AS (SELECT a, b, same, row_number() OVER (PARTITION BY a, same ORDER BY affinity DESC, b) AS r FROM {ends}), kept AS (SELECT a, b, same FROM n WHERE same OR r <= 16), "
    "c AS (SELECT a, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS DOUBLE) AS q FROM kept GROUP BY a), "
    "t AS (SELECT a, p, q, min(x) AS copies FROM c CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8 UNION ALL SELECT 16) xs WHERE 2 * p * x > q OR p = 0 GROUP BY a, p, q) "
    "SELECT k.a AS anchor, k.b AS other, CASE WHEN same THEN greatest(round(4 * q / (5 * p * copies), 6), CAST(1 AS DOUBLE)) ELSE CAST(-1 AS DOUBLE) END AS coefficient, CASE WHEN same THEN copies ELSE 1 END AS copies FROM kept k JOIN t ON t.a = k.a",
    "b13_coreference_examples": "SELECT a AS anchor, b AS other, same, CAST(r AS INTEGER) AS slot FROM (SELECT a, b, same, row_number() OVER (PARTITION BY a, same ORDER BY b) AS r FROM {ends}) x WHERE r <= 3",
    "b14_entities_without_mentions": "SELECT e.eidx FROM {ent} e LEFT JOIN {men} m ON m.gold = e.eidx WHERE m.midx IS NULL",
    "g13_average_linkage_pairs": "SELECT doc, src, dst, CAST(CASE WHEN same THEN 1 ELSE -1 END AS DOUBLE) AS coefficient FROM {mm} WHERE CASE WHEN same THEN round(1 - affinity, 6) > 0.45 ELSE round(1 - affinity, 6) < 0.9 END",
    "j10_positive_edges": "SELECT p.doc, p.a, p.b, p.affinity FROM {ends} p WHERE EXISTS (SELECT 1 FROM {mm} s WHERE s.same AND s.src = least(p.a, p.b) AND s.dst = greatest(p.a, p.b))",
    "j12_out_of_cluster_edges": "SELECT doc, src, dst, affinity FROM {mm} WHERE NOT same",
    "j14_affinity_lookup": f"WITH {NEAR} SELECT n.a, n.b, m.affinity FROM near n LEFT JOIN {{mm}} m ON m.src = least(n.a, n.b) AND m.dst = greatest(n.a, n.b)",
    "j21_candidates_not_gold": "SELECT DISTINCT eidx, midx FROM {cand} EXCEPT SELECT gold, midx FROM {men}",
    "l2_triplet_bpr": "WITH best AS (SELECT midx, max(CASE WHEN eidx = gold THEN affinity END) AS pos, max(CASE WHEN eidx <> gold THEN affinity END) AS neg FROM {scored} GROUP BY midx) SELECT round(avg(1 / (1 + exp(-(neg - pos + 0.5)))), 6) AS loss, count(*) AS triplets FROM best",
    "l5_pair_losses": "SELECT round(avg(abs(CASE WHEN same THEN 1 ELSE 0 END - affinity)), 6) AS absolute, round(sum(CASE WHEN same THEN affinity ELSE -affinity END) / count(*), 6) AS signed FROM {mm}",
    "p6_positives_among_candidates": "SELECT m.midx, m.gold AS eidx FROM {men} m WHERE EXISTS (SELECT 1 FROM {cand} c WHERE c.midx = m.midx AND c.eidx = m.gold)",
    "p15_symmetrized_scores": "SELECT doc, least(a, b) AS src, greatest(a, b) AS dst, round(sum(affinity) / 2, 6) AS affinity FROM {ends} GROUP BY doc, least(a, b), greatest(a, b)",
    "t8_first_thresholds": "SELECT DISTINCT affinity FROM {mm} ORDER BY affinity LIMIT 500",
    "u5_negative_edges": "SELECT doc, a, b FROM {ends} EXCEPT SELECT doc, a, b FROM {ends} WHERE same",
    "u6_augmented_candidates": "SELECT midx, eidx FROM {cand} UNION SELECT midx, gold FROM {men}",
    "w5_negative_chunks": f"WITH {CHUNKS} SELECT midx, chunk, eidx, label FROM ex",
}
