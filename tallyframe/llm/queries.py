"""The registered queries of the corpus operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import chat, collocations, decontaminate, html_text, katz, language, merkle, near_duplicates, packing, quality, token_counts, token_store, toxicity
from tallyframe.llm.common import crc32_mod, scratch_path, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "longest_at")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read(spark, path).withColumnRenamed("key", "doc_id")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs.withColumn("held_out", crc32_mod("doc_id", 5) == 0), model).select("doc_id", "held_out", "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc32_mod("doc_id", 4) == 2)
    contents = language.fit(docs.where("NOT held_out"))
    return language.identify(docs.drop("lang"), contents).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), ["source", "lang", "text"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    path = scratch_path(spark, "chat")
    chat.format_turns(turns).write.parquet(path)
    return chat.read_back(spark, path)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.scores(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 5) != 1)
    return found.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 3) == 0), merkle.leaf_hash(*fields, lowered))
    proven = merkle.manifest(docs.select("doc_id", "lang", merkle.leaf_hash(*fields, F.col("text")).alias("leaf"), tampered.alias("tampered")))
    shown = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _op8_sql(risk: float = 0.02, error: float = 0.05) -> str:
    """The rules of op8_quality in DuckDB: counts by lists, binomial tails by lgamma."""
    rules = list(quality.RULES.items())
    p = risk / len(rules)
    ratios = ", ".join(f"CAST({ratio.replace('/', '::DOUBLE /', 1)} AS DOUBLE) AS {rule}" for rule, (ratio, _) in rules)
    tests = " UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, {i} AS i, CAST({cut} AS DOUBLE) AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {rule} > {cut}) AS k, count(*) FILTER (NOT good AND {rule} > {cut}) AS caught FROM ratios GROUP BY stratum" for rule, (_, cuts) in rules for i, cut in enumerate(cuts))
    failed = ", ".join(f"CASE WHEN {rule} > (SELECT cutoff FROM chosen c WHERE c.stratum = v.stratum AND c.rule = '{rule}') THEN '{rule}' END" for rule, _ in rules)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS p FROM t)),
        rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
        b AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
              CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
              length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(x, '[^!]+', '', 'g')) AS n_exclamations
              FROM t LEFT JOIN rep USING (doc_id)),
        v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {ratios} FROM b),
        ratios AS (SELECT v.*, quality = 1 AS good FROM v JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
        tests AS ({tests}),
        passed AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda z: exp(lgamma(n + 1) - lgamma(z + 1) - lgamma(n - z + 1) + z * ln({p}) + (n - z) * ln(1 - {p}))))
                   <= {error} / ((SELECT count(DISTINCT stratum) FROM ratios) * {len(rules)}) AS ok FROM tests),
        stands AS (SELECT * FROM (SELECT *, coalesce(min(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY stratum, rule), 1000) AS stop FROM passed) WHERE i < stop AND caught > 0),
        chosen AS (SELECT stratum, rule, arg_min(cutoff, i) AS cutoff FROM (SELECT *, max(caught) OVER (PARTITION BY stratum, rule) AS most FROM stands) WHERE caught = most GROUP BY stratum, rule),
        f AS (SELECT *, list_filter([{failed}], lambda y: y IS NOT NULL) AS failed FROM v)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
               coalesce(array_to_string(failed, ','), '') AS failed_rules FROM f"""


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in DuckDB, bit by bit."""
    byte = f"CASE WHEN s % 8 = 0 THEN xor(a, ascii(substr({text}, s // 8 + 1, 1))::BIGINT) ELSE a END"
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length({text}))), lambda a, s: xor(({byte}) >> 1, 3988292384 * (({byte}) & 1))))"


def _op12_sql() -> str:
    """Trees, folded again with tampered leaves, in DuckDB: a level at a time by recursion."""
    fields = [f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")]
    hashed = lambda text: f"sha256({' || '.join(fields)} || coalesce(octet_length(encode({text})) || ':' || {text}, '-'))"
    tampered = hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    up = "SELECT {of}, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY {of}, level + 1, i // 8, (n + 7) // 8"
    follow = "SELECT a.doc_id, a.level + 1, a.i // 8, (a.n + 7) // 8, sha256(string_agg(CASE WHEN b.i = a.i THEN a.h ELSE b.h END, '' ORDER BY b.i)), a.p || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> a.i), '') FROM {t} a JOIN {of} b ON b.{key} IS NOT DISTINCT FROM a.{key} AND b.level = a.level AND b.i // 8 = a.i // 8 WHERE a.n > 1 GROUP BY a.doc_id, a.{key}, a.level, a.i, a.n, a.h, a.p"
    follow = follow.replace("SELECT a.doc_id,", "SELECT a.doc_id, a.{key},")
    return f"""
        WITH RECURSIVE leaf AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
               {hashed('text')} AS h, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {tampered} ELSE {hashed('text')} END AS probe FROM documents),
        low AS (SELECT lang, 0 AS level, i, n, h FROM leaf UNION ALL {up.format(of='lang', t='low')}),
        subs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
        high AS (SELECT 0 AS t, 0 AS level, i, n, h FROM subs UNION ALL {up.format(of='t', t='high')}),
        walk AS (SELECT doc_id, lang, 0 AS level, i, n, probe AS h, '' AS p FROM leaf UNION ALL {follow.format(t='walk', of='low', key='lang')}),
        climb AS (SELECT w.doc_id, 0 AS t, 0 AS level, s.i, s.n, w.h, w.p FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1 UNION ALL {follow.format(t='climb', of='high', key='t')}),
        top AS (SELECT h FROM high WHERE n = 1)
        SELECT l.doc_id, l.h AS leaf, s.h AS subroot, top.h AS root, sha256(c.p) AS proof_sha256, c.h AS folded_root, c.h = top.h AS verified
        FROM leaf l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN climb c ON c.doc_id = l.doc_id AND c.n = 1, top"""


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_store, op3_near_duplicates, op4_pack, op5_toxicity, op6_language, op7_token_counts, op8_quality, op9_chat, op10_html_text, op11_katz, op12_manifest, op13_collocations)}

ORACLES = {
    "op1_decontaminate": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS words
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS words
               FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS p FROM d, ks)),
        hits AS (SELECT doc_id, p, k, item_id FROM dw JOIN bw USING (k, words)),
        bq AS (SELECT r, k, p AS q, array_to_string(w[p : p + k - 1], ' ') AS words FROM (SELECT r, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM (SELECT *, row_number() OVER () AS r FROM b WHERE len(w) > 0))),
        runs AS (SELECT doc_id, k + count(*) - 1 AS n, min(p) - 1 AS first FROM (SELECT doc_id, k, p, r, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, r, p - q ORDER BY p) AS g FROM dw JOIN bq USING (k, words)) GROUP BY doc_id, k, r, d, g),
        far AS (SELECT doc_id, max(n) AS n, arg_min(first, struct_pack(a := -n, b := first)) AS first FROM runs GROUP BY doc_id),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               CAST(coalesce(far.n, 0) AS BIGINT) AS longest_match, CAST(coalesce(far.first, -1) AS BIGINT) AS longest_at
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN far USING (doc_id)""",
    "op3_near_duplicates": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
        m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN m ON node = doc_id LEFT JOIN n USING (doc_id)""",
    "op8_quality": _op8_sql(),
    "op9_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<', '\<')) + length(replace(replace(text, '\', '\\'), '<', '\<')) + 20 AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op12_manifest": _op12_sql(),
    "op13_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        spots AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
        f AS (SELECT lang, m, w[p : p + m - 1] AS words, count(*) AS f FROM spots GROUP BY ALL),
        t AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE m > 1 AND f >= 100),
        cut AS (SELECT lang, m, words, f AS a, unnest(range(1, m)) AS k FROM c),
        s AS (SELECT cut.lang, cut.m, cut.words, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.words = cut.words[1 : k] JOIN f y ON y.lang = cut.lang AND y.words = cut.words[k + 1 : cut.m] JOIN t ON t.lang = cut.lang),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
        inner_ AS (SELECT DISTINCT lang, f, words[i : i + z - 1] AS words FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS z) WHERE z < m AND i + z - 1 <= m),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.words = b.words AND 100 * i.f >= 100 * b.a)),
        o AS (SELECT *, array_to_string(words, ' ') AS phrase FROM kept)
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM o QUALIFY rank <= 2000""",
}
