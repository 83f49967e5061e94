"""The registered queries of this package and the SQL that the expressible ones must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrosheaf.llm import chat, decontam, extract, lexical, licenses, mixing, neighbours, ngram_join, quality, repair, sharding, suffix_dedup, toxicity
from hydrosheaf.llm.tables import read, staged

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op2_ngram_join")
def op2_ngram_join(spark, sf_dir):
    return ngram_join.joined(read(spark, sf_dir, "documents"))


def license_sql(documents: str = "documents", templates=licenses.TEMPLATES) -> str:
    quoted = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]"
    grams = [licenses.ordered_bigrams(text) for _, text in templates]
    rows = ", ".join(f"({t}, '{name}', {len(g)}, {quoted(sorted(set(g)))})" for t, ((name, _), g) in enumerate(zip(templates, grams)))
    laid = ", ".join(f"('{g}', {t}, {at})" for g, lays in licenses.lays(templates).items() for t, at in lays)
    dice = "2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams))"
    return f"""
WITH templates(t, license, n, grams) AS (VALUES {rows}),
anchors(gram, t, off) AS (VALUES {laid}),
docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM {documents}),
units AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS u FROM docs
  UNION ALL SELECT doc_id, 'whole', text FROM docs),
words AS (SELECT doc_id, kind, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
sets AS (SELECT row_number() OVER () AS r, doc_id, kind, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM words WHERE len(w) > 1),
best AS (
  SELECT r, doc_id, kind, max(struct_pack(dice := dice, license := license)) AS b FROM (SELECT r, doc_id, kind, license, {dice} AS dice FROM sets, templates)
  WHERE dice >= {licenses.LEAST} GROUP BY ALL),
texts AS (SELECT d, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM docs),
runs AS (SELECT d, doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS all_g FROM texts WHERE len(w) > 1),
spots AS (SELECT d, p - 1 AS p, all_g[p] AS gram FROM (SELECT d, all_g, unnest(range(1, len(all_g) + 1)) AS p FROM runs)),
laid AS (SELECT DISTINCT d, a.t, greatest(p - off, 0) AS s FROM spots JOIN anchors a USING (gram)),
windows AS (SELECT laid.d, doc_id, s, license, grams, least(len(all_g) - s, n) + 1 AS n, list_distinct(all_g[s + 1:s + n]) AS g FROM laid JOIN runs USING (d) JOIN templates USING (t)),
scored AS (SELECT d, doc_id, s, n, license, -{dice} AS o, -len(g) AS short FROM windows WHERE {dice} >= {licenses.LEAST}),
firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY d, s ORDER BY o, short, license, n) = 1),
kept AS (SELECT * FROM firsts x WHERE NOT EXISTS (SELECT 1 FROM firsts y WHERE y.d = x.d AND y.s < x.s + x.n AND x.s < y.s + y.n AND (y.o < x.o OR y.o = x.o AND (y.short < x.short OR y.short = x.short AND y.s < x.s)))),
finds AS (SELECT doc_id, kind, b.license AS license, b.dice AS dice FROM best UNION ALL SELECT doc_id, 'place', license, -o FROM kept)
SELECT doc_id, license, round(max(dice), 9) AS dice, count(*) FILTER (kind = 'line') AS n_lines, count(*) FILTER (kind = 'place') AS n_places, bool_or(kind = 'whole') AS whole
FROM finds GROUP BY doc_id, license"""


@query("op3_license_scan", license_sql())
def op3_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(read(spark, sf_dir, "documents"))


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op4_chat_formatting")
def op4_chat_formatting(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.formatted(chat.events_of(turns.unionByName(probe))))


@query("op9_html_extraction")
def op9_html_extraction(spark, sf_dir):
    return extract.extracted(read(spark, sf_dir, "pages"))


_LINE_FAILS = f"""(sym * 10 > solid OR (loud * 4 >= nw AND loud > 0)
 OR (x = upper(x) AND x <> lower(x) AND nw >= 4 AND solid >= 20)
 OR (bars >= 2 AND bars * 4 >= nw)
 OR (nw <= 40 AND regexp_matches(lower(x), '{"|".join(quality.NOTICES)}')))"""


@query("op5_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
grams AS (SELECT doc_id, [w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FOR k IN range(1, len(w) - 1)] AS g FROM w WHERE len(w) >= 3),
pos AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS s FROM grams),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
facts AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS nw, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS solid,
  len(regexp_extract_all(x, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(x, '[!?]{{2,}}')) AS loud, len(regexp_extract_all(x, '{quality.SEPARATORS}')) AS bars FROM lines),
per AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dups, sum(CASE WHEN {_LINE_FAILS} THEN solid ELSE 0 END) AS lost FROM facts WHERE nw > 0 GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, lost_chars,
  (n_words < {quality.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality.MOST_REPEATED}) AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality.MOST_REPEATED}) AND lost_chars * 100 <= word_chars * {quality.MOST_LOST} AS kept
FROM base""")
def op5_quality_rules(spark, sf_dir):
    return quality.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"
    )


def _windows_sql(documents: str, benchmark: str) -> str:
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = decontam.WINDOW
    return f"""
items AS (SELECT item_id, regexp_extract_all({low}, '{pattern}') AS w FROM {benchmark}),
windows AS (SELECT DISTINCT item_id, least(len(w), {n}) AS k, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{pattern}') AS w FROM {documents}),
spots AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT r, spots.k, i, item_id FROM spots JOIN windows USING (k, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)"""


@query("op7_decontamination", f"""WITH {_windows_sql('documents', 'benchmark')}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""")
def op7_decontamination(spark, sf_dir):
    return decontam.digest(decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


_DRAWN = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT / 4294967296.0::DOUBLE AS u{i}" for i in range(mixing.DRAWS))
_SUMS = ", ".join(f"floor(rate) * any_value(source_size) + sum(CASE WHEN u{i} < part THEN size ELSE 0 END) - any_value(target) AS o{i}" for i in range(mixing.DRAWS))
_PICK = f"list_position([{', '.join(f'abs(o{i})' for i in range(mixing.DRAWS))}], least({', '.join(f'abs(o{i})' for i in range(mixing.DRAWS))}))"


def mixing_sql(documents: str = "documents") -> str:
    """``mixed(doc_id, size, source_size, target, copies)`` over a table of documents, as CTEs."""
    return f"""
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, sha256(coalesce(doc_id::VARCHAR, 'null')) AS h FROM {documents}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
run AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
  coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
lev AS (SELECT max((total - filled) / open) AS l FROM run WHERE (total - filled) / open * w <= cap),
aim AS (SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, l * w) END AS target FROM run, lev),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aim),
u AS (SELECT s.*, source_size, target, rate, rate - floor(rate) AS part, {_DRAWN} FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
offs AS (SELECT source, rate, part, {_SUMS} FROM u GROUP BY source, rate, part),
pick AS (SELECT source, {_PICK} AS k FROM offs),
mixed AS (SELECT u.* EXCLUDE (source), u.source, (floor(rate) + CASE WHEN [{", ".join(f"u{i}" for i in range(mixing.DRAWS))}][k] < part THEN 1 ELSE 0 END)::INT AS copies
  FROM u JOIN pick p ON u.source IS NOT DISTINCT FROM p.source)"""


@query("op8_source_mixing", f"""WITH {mixing_sql()}
SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken FROM mixed""")
def op8_source_mixing(spark, sf_dir):
    return mixing.plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


def sharding_sql(documents: str = "documents") -> str:
    """``jumped(doc_id, shard, grown_shard)`` per distinct key, as CTEs behind WITH RECURSIVE."""
    n = sharding.SHARDS
    return f"""
keys AS (SELECT DISTINCT doc_id, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::HUGEINT * 4294967296
  + ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 9, 8))::BIGINT) AS k FROM {documents}),
jumps(doc_id, k, b, j) AS (
  SELECT doc_id, k, -1::BIGINT, 0::BIGINT FROM keys
  UNION ALL
  SELECT doc_id, nk, j, floor((j + 1)::DOUBLE * 2147483648.0::DOUBLE / ((nk // 8589934592)::BIGINT + 1)::DOUBLE)::BIGINT
  FROM (SELECT *, (k * {sharding.STEP}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM jumps WHERE j <= {n})),
jumped AS (SELECT doc_id, max(b) FILTER (b < {n})::INT AS shard, max(b) FILTER (b <= {n})::INT AS grown_shard FROM jumps GROUP BY doc_id)"""


# CRC-32 of a text in SQL: the table by its rule, then one fold over the bytes
_CRC = """
bits(n, x, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT n, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY n) AS t FROM bits WHERE k = 8)"""
def _crc_of(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])), 4294967295)"""


@query("op10_jump_sharding", f"""WITH RECURSIVE {sharding_sql()},{_CRC},
rows AS (SELECT d.doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc_of("coalesce(text, '')")} AS text_crc32, shard, grown_shard FROM documents d JOIN jumped j ON d.doc_id IS NOT DISTINCT FROM j.doc_id, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot FROM rows""")
def op10_jump_sharding(spark, sf_dir):
    return sharding.shard_table(read(spark, sf_dir, "documents"))


# edits over the states 0 (nothing yet), s, u and a; a value is the cost, padded, and the audit behind it
_INSERTS = "('0', '0', 0, ''), ('0', 'u', 3, 'I'), ('0', 'a', 6, 'II'), ('s', 's', 0, ''), ('s', 'u', 3, 'I'), ('s', 'a', 6, 'II'), ('u', 'u', 0, ''), ('u', 'a', 3, 'I'), ('a', 'a', 0, ''), ('a', 'u', 3, 'I')"
_MOVES = "('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')"
_ADD = "lpad((substr(v, 1, 9)::BIGINT + {})::VARCHAR, 9, '0') || substr(v, 10) || {}"
_REPAIR = f"""WITH RECURSIVE {_CRC.strip()},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc_of("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE k <> 0),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, substr(role, 1, 1) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM rows),
faults AS (SELECT *, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND dup) AS duplicate,
  count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faults GROUP BY conv_id),
ins(f, g, c, e) AS (VALUES {_INSERTS}), moves(f, o, g) AS (VALUES {_MOVES}),
best(conv_id, pos, st, v) AS (
  SELECT conv_id, 0::BIGINT, '0', '000000000' FROM convs
  UNION ALL
  SELECT conv_id, pos, st, min(v) FROM (
    SELECT r.conv_id, r.pos, unnest([
        struct_pack(st := g, v := {_ADD.format("4", "'D'")}),
        struct_pack(st := CASE WHEN NOT gone THEN (SELECT any_value(m.g) FROM moves m WHERE m.f = x.g AND m.o = i) END, v := {_ADD.format("more", "'K'")}),
        struct_pack(st := CASE WHEN NOT gone AND i <> 'u' THEN (SELECT any_value(m.g) FROM moves m WHERE m.f = x.g AND m.o = 'u') END, v := {_ADD.format("more + 3", "'R'")}),
        struct_pack(st := CASE WHEN NOT gone AND i <> 'a' THEN (SELECT any_value(m.g) FROM moves m WHERE m.f = x.g AND m.o = 'a') END, v := {_ADD.format("more + 3", "'R'")})], recursive := true)
    FROM (SELECT conv_id, pos, g, {_ADD.format("c", "e")} AS v FROM best JOIN ins ON f = st) x JOIN faults r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.pos = x.pos + 1)
  WHERE st IS NOT NULL GROUP BY conv_id, pos, st),
done AS (SELECT b.conv_id, min({_ADD.format("CASE st WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END", "CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END")}) AS v
  FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id WHERE pos = coalesce(n, 0) GROUP BY b.conv_id),
marks AS (SELECT conv_id, substr(v, 10) AS audit, len(replace(substr(v, 10), 'D', '')) % 2 AS odd, unnest(range(1, len(v) - 8)) AS j FROM done),
steps AS (SELECT conv_id, j, odd, audit[j:j] AS e, len(replace(audit[1:j], 'I', '')) AS pos, len(replace(audit[1:j], 'D', '')) AS k FROM marks),
lines AS (SELECT s.conv_id, j, CASE WHEN e = 'K' THEN r.role WHEN (k - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS line
  FROM steps s LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS text FROM lines GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, substr(v, 1, 9)::BIGINT AS cost, substr(v, 10) AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM done d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query("op11_structure_repair", _REPAIR)
def op11_structure_repair(spark, sf_dir):
    rows = repair.damaged(read(spark, sf_dir, "conversations"))
    return repair.digest(rows, staged(repair.plans(rows)))


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_lexical_search", f"""WITH
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{lexical.PATTERN}') AS w FROM documents),
size AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
every AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
items AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOW}, '{lexical.PATTERN}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM items) GROUP BY q, term),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weight AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), every),
part AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS s FROM post JOIN weight USING (term) JOIN size USING (r), every),
scored AS (SELECT q, r, sum(s * times)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY q, r HAVING sum(s * times) > 0),
best AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN size USING (r))
SELECT item_id, rank::INT AS rank, doc_id, score FROM best JOIN items USING (q) WHERE rank <= {lexical.TOP}""")
def op13_lexical_search(spark, sf_dir):
    return lexical.ranked_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
