"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelens.llm import decontaminate, exact, html, lines, lm, merkle, mixing, packing, runs, secrets, simhash, tiff, toxicity
from wirelens.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints of 4-word shingles differ in 4 bits or fewer: ``simhash.simhash_groups``."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2,048 tokens: ``packing.pack``."""
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from labelled ones: ``toxicity.toxicity``."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, with the hash of every text: ``exact.exact_groups``."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by novelty in every document: ``secrets.digest``."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes of every document: ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by word counts and by the attention model: ``lm.score``."""
    import public_tokenizers

    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeats of runs of lines: ``lines.line_dedup``."""
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: ``html.extract``."""
    return html.extract(table(spark, sf_dir, "pages"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as TIFF and read back: ``tiff.texts_read_back``."""
    return tiff.texts_read_back(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which are made to repeat a stretch: ``runs.digest``."""
    return runs.digest(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items, and those items: ``decontaminate.digest``."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash tree over all documents, and each document's proof folded again: ``merkle.tamper_check``."""
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_toxicity, op4_exact_dedup, op5_secrets, op6_mixing, op7_lm, op8_lines, op9_html, op10_tiff, op11_runs, op12_decontaminate, op13_merkle)}

#: CRC32 of an ASCII string in SQL: bytes of a list folded bit by bit, 3988292384 being the reversed polynomial.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT))))"""

ORACLE_SQL = {
    "op11_runs": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
        g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
        made AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM g),
        pos AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM made),
        same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
        stretch AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
        found AS (SELECT doc_id, min(i) AS s, count(*) + p AS len, p FROM stretch GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(12, 2 * p)),
        run AS (SELECT doc_id, s, len, min(p) AS p FROM found GROUP BY ALL),
        best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, p) = 1),
        every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM run GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM run),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, p AS period, 1000 * len // p AS exponent_milli,
          sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op12_decontaminate": """
        WITH low AS (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
        w AS (SELECT doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
        item AS (SELECT item_id, w, least(10, len(w)) AS size FROM w WHERE item_id IS NOT NULL AND len(w) > 0),
        win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item)),
        place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM win) WHERE doc_id IS NOT NULL AND len(w) >= size),
        hit AS (SELECT doc_id, i, size, item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM place) JOIN win USING (size, t)),
        n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id) WHERE doc_id IS NOT NULL
    """,
    "op13_merkle": f"""
        WITH RECURSIVE f AS (
          SELECT doc_id, lang, {CRC32.format("doc_id::VARCHAR")} % 7 = 0 AS hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
        leaves AS (
          SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n,
            sha256(head || n || tail) AS leaf, sha256(head || CASE WHEN hit THEN n1 ELSE n END || tail) AS start FROM f),
        low AS (
          SELECT g, 0 AS lvl, ix, n, leaf AS h FROM leaves
          UNION ALL SELECT g, lvl + 1, ix // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY ix)) FROM low WHERE n > 1 GROUP BY g, lvl, ix // 2, n),
        sub AS (SELECT g, h FROM low WHERE n = 1),
        top AS (
          SELECT 0 AS lvl, g AS ix, count(*) OVER () AS n, h FROM sub
          UNION ALL SELECT lvl + 1, ix // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY ix)) FROM top WHERE n > 1 GROUP BY lvl, ix // 2, n),
        step AS (
          SELECT l.doc_id, o.lvl, o.ix % 2 = 1 AS behind, coalesce(s.h, '') AS s FROM leaves l JOIN low o ON o.g = l.g AND o.ix = l.ix >> o.lvl AND o.n > 1 LEFT JOIN low s ON s.g = o.g AND s.lvl = o.lvl AND s.ix = xor(o.ix, 1)
          UNION ALL SELECT l.doc_id, 1000 + o.lvl, o.ix % 2 = 1, coalesce(s.h, '') FROM leaves l JOIN top o ON o.ix = l.g >> o.lvl AND o.n > 1 LEFT JOIN top s ON s.lvl = o.lvl AND s.ix = xor(o.ix, 1)),
        path AS (SELECT doc_id, string_agg(s, '' ORDER BY lvl) AS proof, list(CASE WHEN behind THEN '<' ELSE '>' END || s ORDER BY lvl) AS steps FROM step GROUP BY doc_id),
        folded AS (
          SELECT l.doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
            list_reduce(list_prepend(start, coalesce(steps, [])), lambda acc, x: sha256(CASE WHEN x[1] = '<' THEN x[2:] || acc ELSE acc || x[2:] END)) AS folded_root
          FROM leaves l JOIN sub USING (g) LEFT JOIN path USING (doc_id))
        SELECT *, folded_root = root AS verified FROM folded
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
