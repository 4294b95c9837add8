"""The queries of the operators with production parameters, each over its whole table."""

from __future__ import annotations

from . import alignment, bpe, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, langid, mixing, pii, repeats, secrets, sharding, url_filter
from .common import table

#: The rules that page urls are held against.
RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


def tokenizer() -> dict:
    """Place of the rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def two_tokenizers() -> dict:
    """Places of the files of a byte-level tokenizer and of a SentencePiece model, and the pattern of the first."""
    import public_tokenizers

    return {"path_a": public_tokenizers.path("byte_bpe_50k.json"), "path_b": public_tokenizers.path("piece_bpe_32k.model"), "pattern": public_tokenizers.PATTERN}


QUERIES = {
    "op1_embedding_near_dedup": lambda spark, d: embedding_dedup.near_duplicates(table(spark, d, "embeddings")),
    "op2_pii": lambda spark, d: pii.pii_report(table(spark, d, "documents")),
    "op3_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op4_language_id": lambda spark, d: langid.language_id(table(spark, d, "documents")),
    "op5_url_filter": lambda spark, d: url_filter.filter_urls(table(spark, d, "pages"), RULES, telling=url_filter.TELLING),
    "op6_secrets": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op7_sharding": lambda spark, d: sharding.shard(table(spark, d, "documents")),
    "op8_bpe": lambda spark, d: bpe.encode_digests(table(spark, d, "documents"), **tokenizer()),
    "op9_jaccard_join": lambda spark, d: jaccard_join.jaccard_join(table(spark, d, "documents")),
    "op10_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
    "op11_repeats": lambda spark, d: repeats.repeat_digests(table(spark, d, "documents")),
    "op12_hard_negatives": lambda spark, d: hard_negatives.mine_embeddings(table(spark, d, "embeddings")),
    "op13_alignment": lambda spark, d: alignment.align_digests(table(spark, d, "documents"), **two_tokenizers()),
}

_SPACE = r"[\x20\x09-\x0D]+"

ORACLES = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.m, vec_id) AS component_id, coalesce(m.m, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        -- Equal sets are one set, so that copies are not held against each other shingle by shingle.
        g AS (SELECT min(doc_id) AS g, list_sort(s) AS s, count(*) AS n FROM s GROUP BY 2), d AS (SELECT doc_id, g FROM s JOIN g ON list_sort(s.s) = g.s),
        u AS (SELECT g, len(s) AS size, unnest(s) AS x FROM g),
        p AS (SELECT a.g AS a, b.g AS b FROM u a JOIN u b ON a.x = b.x AND a.g <> b.g GROUP BY a.g, b.g, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
        r(a, b) AS (SELECT g, g FROM g UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
        k AS (SELECT g.g, g.n - 1 + coalesce((SELECT sum(o.n) FROM p JOIN g o ON o.g = p.b WHERE p.a = g.g), 0) AS n_links, (SELECT min(b) FROM r WHERE r.a = g.g) AS c FROM g)
        SELECT t.doc_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(k.c, t.doc_id) AS component_id, coalesce(k.c, t.doc_id) = t.doc_id AS kept
        FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN k ON k.g = d.g""",
    "op10_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t""",
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_inner_product(a.x::DOUBLE[], o.x::DOUBLE[])::BIGINT AS score
          FROM r a JOIN r o ON a.vec_id <> o.vec_id AND len(a.x) = len(o.x) WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op3_mixing": r"""
        WITH t AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '?') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS w FROM t GROUP BY source),
        o AS (SELECT *, 2 * ss AS cap, 2 * ss / w AS ratio, sum(ss) OVER () AS total FROM s),
        c AS (SELECT *, sum(cap) OVER q - cap AS before, sum(w) OVER () - sum(w) OVER q + w AS remaining FROM o
              WINDOW q AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT *, (1.5::DOUBLE * total - before) / remaining AS level FROM c),
        f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE cap > level * w),
        g AS (SELECT l.source, l.ss, CASE WHEN f.level IS NULL OR cap <= f.level * w THEN cap::DOUBLE ELSE f.level * w END AS target FROM l, f),
        p AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS passes FROM g),
        x AS (SELECT t.*, p.ss, p.target, p.passes, p.target - p.passes * p.ss AS rest, sum(size) OVER (PARTITION BY t.source ORDER BY h) AS upto,
                     sum(size) OVER (PARTITION BY t.source, h) AS here, row_number() OVER (PARTITION BY t.source, h) AS nth FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, ss AS source_size, target,
               size * (passes + CASE WHEN upto < rest OR (upto - here < rest AND nth <= ceil((rest - (upto - here)) / size - 0.5)) THEN 1 ELSE 0 END) AS taken FROM x""",
}
