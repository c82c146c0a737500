"""Questions and answers over whole conversations: references, exact retrieval, routing, citations, verdicts, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, ranking, regulations, retrieval
from docloom.plans import regulations as laws
from docloom.plans.registry import query
from docloom.session import cut_lineage, table

# References that stand-in questions begin with; the driver's conversations hold none.
ASKED = [
    "Apa isi Pasal 1?", "Apa isi Pasal 2 ayat 2?", "Pasal 1 ayat (1) huruf a", "BAB I Pasal 3", "angka 2 huruf a", "bab II butir 1", "KESATU", "Lihat Lampiran II", "Apa isi KEDUA dalam keputusan ini?",
    "mitigasi risiko", "Bandingkan Pasal 1 dan Pasal 2", "Lampiran iv", "bagian 1", "Apa dasar hukum dan siapa penyelenggara?", "bab i", "poin 2a",
]
_Q = f"q AS (SELECT conv_id, turn, 'src' || conv_id % 20 AS organization, conv_id % 3 AS who, ({ASKED})[(conv_id + turn) % {len(ASKED)} + 1] || ' ' || coalesce(text, '') AS question FROM conversations WHERE role = 'user')"
_REF = r"(?i)\bpasal\s+\d+[a-z]?\b|\bayat\s+\(?\d+\)?|\bhuruf\s+[a-z]\b|\bbab\s+[ivxlcdm]+\b|\b(?:angka|butir|poin|bagian)\s+\d+[a-z]?\b|\blampiran\s+(?:[ivxlcdm]+|\d+)\b|\b(?:" + "|".join(T.ORDINALS) + r")\b"
_PARSED = _Q + rf""",
rf AS (SELECT *, list_transform(regexp_extract_all(question, '{_REF}'), lambda m: lower(regexp_replace(m, '[()]', '', 'g'))) AS refs FROM q),
rv AS (SELECT *, list_filter(refs, lambda m: m LIKE 'pasal %')[-1] AS pasal, list_filter(refs, lambda m: m LIKE 'ayat %')[-1] AS ayat, list_filter(refs, lambda m: m LIKE 'huruf %')[-1] AS huruf, list_filter(refs, lambda m: m LIKE 'lampiran %')[-1] AS lampiran,
   list_filter(refs, lambda m: list_contains({T.ORDINALS}, upper(m)))[-1] AS ordinal, list_filter(refs, lambda m: regexp_matches(m, '^(huruf|bab|angka|butir|poin|bagian) ')) AS steps FROM rf),
parsed AS (SELECT conv_id, turn, organization, who, question, CASE WHEN pasal IS NOT NULL THEN 'ARTICLE' WHEN lampiran IS NOT NULL THEN 'APPENDIX' WHEN ordinal IS NOT NULL THEN 'DECISION' WHEN len(steps) > 0 THEN 'GENERIC_PATH' END AS kind,
   regexp_extract(pasal, '(\S+)$', 1) AS article, CASE WHEN pasal IS NOT NULL THEN regexp_extract(ayat, '(\S+)$', 1) END AS clause, CASE WHEN pasal IS NOT NULL THEN regexp_extract(huruf, '(\S+)$', 1) END AS letter,
   CASE WHEN pasal IS NULL THEN upper(regexp_extract(lampiran, '(\S+)$', 1)) END AS appendix, CASE WHEN pasal IS NULL AND lampiran IS NULL THEN upper(ordinal) END AS decision,
   CASE WHEN pasal IS NULL AND lampiran IS NULL AND ordinal IS NULL AND len(steps) > 0 THEN list_transform(steps, lambda m: CASE WHEN m LIKE 'bab %' THEN upper(regexp_extract(m, '(\S+)$', 1)) ELSE regexp_extract(m, '(\S+)$', 1) END) END AS terms FROM rv)"""


def questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = F.get(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int"))
    return rows.select(
        "conv_id", "turn", F.concat(F.lit("src"), F.col("conv_id") % 20).alias("organization"), (F.col("conv_id") % 3).alias("who"), F.concat(asked, F.lit(" "), F.coalesce("text", F.lit(""))).alias("question")
    )


@query(f"WITH {_PARSED} SELECT conv_id, turn, kind, article, clause, letter, appendix, decision, array_to_string(terms, '>') AS path FROM parsed")
def parse_reference(spark, sf_dir):
    found = questions(spark, sf_dir).withColumn("x", T.parse_reference(F.col("question")))
    return found.select("conv_id", "turn", "x.kind", "x.article", "x.clause", "x.letter", "x.appendix", "x.decision", F.array_join("x.terms", ">").alias("path"))


@query(rf"""
WITH {_Q} SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 OR regexp_matches(question, '(?i)\b(bandingkan|dibandingkan|perbedaan|dibanding|perbandingan)\b')
  OR len(regexp_extract_all(question, '(?i)\b(apa|bagaimana|siapa|mengapa|kapan|berapa|kenapa)\b')) > 1 THEN 'STRONG' ELSE 'FAST' END AS tier FROM q""")
def model_tier(spark, sf_dir):
    """The tier of every question; each fifth conversation's evidence lies in two documents."""
    n_documents = F.when(F.col("conv_id") % 5 == 0, 2).otherwise(1)
    return questions(spark, sf_dir).select("conv_id", "turn", T.model_tier(F.col("question"), n_documents).alias("tier"))


_CHUNKS = """
chunks AS (SELECT n.doc_id, n.pos, n.kind, article_number, clause_number, letter_number, mark, style, labels, source AS organization, doc_id % 3 AS visible, CASE WHEN doc_id % 5 = 4 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status,
   CASE WHEN text_of LIKE 'LAMPIRAN %' THEN regexp_extract(text_of, '^LAMPIRAN (\\S+)', 1) END AS appendix_number, CASE WHEN style IS NOT NULL THEN mark END AS number FROM (SELECT *, text AS text_of FROM named) n JOIN documents d USING (doc_id)),
hits AS (SELECT p.conv_id, p.turn, c.doc_id, c.pos, p.kind FROM parsed p JOIN chunks c ON c.organization = p.organization AND c.status = 'ACTIVE' AND c.visible <= p.who AND CASE p.kind
   WHEN 'ARTICLE' THEN c.article_number = p.article AND (p.clause IS NULL OR c.clause_number = p.clause) AND (p.letter IS NULL OR c.letter_number = p.letter)
   WHEN 'APPENDIX' THEN upper(c.appendix_number) = p.appendix WHEN 'DECISION' THEN upper(c.number) = p.decision
   WHEN 'GENERIC_PATH' THEN regexp_matches(chr(1) || array_to_string(list_transform(labels, lambda l: ' ' || lower(trim(l)) || ' '), chr(1)) || chr(1),
        array_to_string(list_transform(p.terms, lambda t: '\\x01[^\\x01]* ' || lower(t) || ' [^\\x01]*'), '(?:\\x01[^\\x01]*)*') || '\\x01') ELSE false END)"""


def chunks(spark, sf_dir):
    """Nodes as chunks with what a read is scoped by."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("organization"), F.lit("all").alias("space"))
    visibility = F.get(F.array(*map(F.lit, ("PUBLIC", "INTERNAL", "RESTRICTED"))), (F.col("doc_id") % 3).cast("int"))
    found = laws.with_paths(spark, sf_dir).join(docs, "doc_id")
    appendix = F.nullif(F.regexp_extract("text", r"^LAMPIRAN (\S+)", 1), F.lit(""))
    return found.select(
        "doc_id", "pos", "kind", "article_number", "clause_number", "letter_number", "marker", "labels", "depth", "path", "text", "organization", "space", F.col("doc_id").alias("document_id"), visibility.alias("visibility"),
        F.when(F.col("doc_id") % 5 == 4, "ARCHIVED").otherwise("ACTIVE").alias("status"), appendix.alias("appendix_number"),
    )


def _asked(spark, sf_dir):
    """What every question refers to, and the chunks it looks in."""
    roles = F.get(F.array(*map(F.lit, ("VIEWER", "EDITOR", "OWNER"))), F.col("who").cast("int"))
    asked = questions(spark, sf_dir).select("conv_id", "turn", "organization", roles.alias("role"), F.inline(F.array(T.parse_reference(F.col("question")))))
    return asked, chunks(spark, sf_dir)


@query(f"WITH {laws.PATHS}, {_PARSED}, {_CHUNKS} SELECT conv_id, turn, kind, doc_id, pos FROM hits")
def exact_match(spark, sf_dir):
    """Every question's reference matched to the visible, active nodes of its organization."""
    return retrieval.exact_matches(*_asked(spark, sf_dir), ["conv_id", "turn"])


@query(f"""
WITH {laws.PATHS}, {_PARSED}, {_CHUNKS}, n AS (SELECT conv_id, turn, count(*) AS n_exact, count(DISTINCT doc_id) AS n_documents FROM hits GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN n_exact > 0 THEN 'EXACT_STRUCTURAL' ELSE 'HYBRID' END AS mode, coalesce(n_exact, 0) AS n_exact, coalesce(n_documents, 0) AS n_documents, coalesce(n_documents > 1, false) AS rerank FROM q LEFT JOIN n USING (conv_id, turn)""")
def retrieval_route(spark, sf_dir):
    """Exact where a reference hits, else hybrid; exact hits are reranked only over several documents."""
    found = retrieval.exact_counts(*_asked(spark, sf_dir), ["conv_id", "turn"])
    joined = questions(spark, sf_dir).select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").na.fill(0)
    mode = F.when(F.col("n_exact") > 0, "EXACT_STRUCTURAL").otherwise("HYBRID")
    return joined.select("conv_id", "turn", mode.alias("mode"), "n_exact", "n_documents", ((F.col("n_exact") > 1) & (F.col("n_documents") > 1)).alias("rerank"))


@query("""
SELECT doc_id, 'one document' AS scope FROM documents WHERE source = 'src1' AND doc_id % 3 < 2 AND doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1' AND doc_id % 3 < 2 AND doc_id % 5 = 4)
UNION ALL SELECT doc_id, 'space' FROM documents WHERE source = 'src1' AND doc_id % 3 < 2 AND doc_id % 5 <> 4 AND lang = 'en'
UNION ALL SELECT doc_id, role FROM documents, (VALUES ('VIEWER', 1), ('EDITOR', 2), ('ADMIN', 3), ('OWNER', 3)) AS r(role, sees) WHERE source = 'src1' AND doc_id % 3 < sees AND doc_id % 5 <> 4""")
def scope_variants(spark, sf_dir):
    """What each role sees of a tenant, what a space leaves, and one archived document in test mode."""
    visibility = F.get(F.array(*map(F.lit, ("PUBLIC", "INTERNAL", "RESTRICTED"))), (F.col("doc_id") % 3).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("document_id"), F.col("source").alias("organization"), F.col("lang").alias("space"), visibility.alias("visibility"), F.when(F.col("doc_id") % 5 == 4, "ARCHIVED").otherwise("ACTIVE").alias("status")
    )
    archived = docs.where("organization = 'src1' and status = 'ARCHIVED' and doc_id % 3 < 2").agg(F.min("doc_id").alias("chosen"))
    single = ranking.scoped(docs.join(F.broadcast(archived)), "src1", "EDITOR", document=F.col("chosen")).select("doc_id", F.lit("one document").alias("scope"))
    found = single.unionByName(ranking.scoped(docs, "src1", "EDITOR", space="en").select("doc_id", F.lit("space").alias("scope")))
    for role in ranking.VISIBLE:
        found = found.unionByName(ranking.scoped(docs, "src1", role).select("doc_id", F.lit(role).alias("scope")))
    return found


# Answers: an assistant's turn cited in one of five ways; its evidence are the two turns before it.
_A = """
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN text || ' [S1]' WHEN 1 THEN text || ' [S1, S2] Pasal 3 ' || text || ' [S9]' WHEN 2 THEN text WHEN 3 THEN 'Menurut Pasal 3 ' || text || ' [S1] lalu ' || text || ' [ S2 ]' ELSE text || ' [S1][S2] tail' END AS text FROM t WHERE role = 'assistant'),
ev AS (SELECT conv_id, turn + d AS turn, 'S' || d AS source_id, d AS place, turn + 1 AS page, CASE WHEN conv_id % 2 = 0 THEN 'BAB I > Pasal 3' ELSE '11. Umum' END AS path, text FROM t, (VALUES (1), (2)) AS x(d))"""
_CLAIMS = _A + r""",
w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '(?s)(.+?)\[\s*((?:S\d+\s*,?\s*)+)\]') AS whole, regexp_extract_all(text, '(?s)(.+?)\[\s*((?:S\d+\s*,?\s*)+)\]', 1) AS said, regexp_extract_all(text, '(?s)(.+?)\[\s*((?:S\d+\s*,?\s*)+)\]', 2) AS ids FROM a),
u AS (SELECT conv_id, turn, i, CASE WHEN i <= len(whole) THEN whole[i] ELSE text[coalesce(list_sum(list_transform(whole, lambda x: length(x))), 0)::BIGINT + 1:] END AS span,
        CASE WHEN i <= len(whole) THEN said[i] END AS said, CASE WHEN i <= len(whole) THEN regexp_extract_all(ids[i], 'S\d+') ELSE [] END AS ids FROM (SELECT *, unnest(range(1, len(whole) + 2)) AS i FROM w)),
s AS (SELECT *, regexp_replace(coalesce(said, span), '^\s+|\s+$', '', 'g') AS claim FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS claim_no FROM s WHERE claim <> '')"""
_CHECKED = _CLAIMS + r""",
tok AS (SELECT conv_id, turn, source_id, path, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4)) AS tokens FROM ev),
cm AS (SELECT c.conv_id, c.turn, c.claim_no, bool_and(k.source_id IS NOT NULL) AS all_known, bool_or(coalesce(contains(lower(path), 'pasal'), false)) AS article_cited, list_distinct(flatten(list(tokens) FILTER (WHERE tokens IS NOT NULL))) AS tokens
   FROM (SELECT *, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS id FROM c) c LEFT JOIN tok k ON k.conv_id = c.conv_id AND k.turn = c.turn AND k.source_id = c.id GROUP BY ALL),
own AS (SELECT c.*, all_known, article_cited, tokens, list_distinct(list_filter(regexp_extract_all(lower(claim), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4)) AS mine FROM c JOIN cm USING (conv_id, turn, claim_no)),
checked AS (SELECT *, round(CASE WHEN len(mine) = 0 THEN 0 ELSE len(list_intersect(mine, coalesce(tokens, []))) / len(mine) END, 6) AS overlap, CASE WHEN NOT all_known OR (regexp_matches(claim, '(?i)\bpasal\s+\d+') AND NOT article_cited) THEN 'UNSUPPORTED' WHEN len(mine) = 0 THEN 'UNCERTAIN'
   WHEN len(list_intersect(mine, coalesce(tokens, []))) / len(mine) >= 0.3 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS status FROM own)"""
KEYS = ["conv_id", "turn"]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def cited(rows):
    """The assistant's turns of ``rows`` with the citations they are given."""
    how = (F.col("conv_id") + F.col("turn")) % 5
    text = F.coalesce("text", F.lit(""))
    said = (
        F.when(how == 0, F.concat(text, F.lit(" [S1]"))).when(how == 1, F.concat(text, F.lit(" [S1, S2] Pasal 3 "), text, F.lit(" [S9]"))).when(how == 2, text)
        .when(how == 3, F.concat(F.lit("Menurut Pasal 3 "), text, F.lit(" [S1] lalu "), text, F.lit(" [ S2 ]"))).otherwise(F.concat(text, F.lit(" [S1][S2] tail")))
    )
    return rows.where("role = 'assistant'").select(*KEYS, said.alias("text"))


def _answers(spark, sf_dir):
    return cited(_turns(spark, sf_dir))


def _evidence(spark, sf_dir):
    path = F.when(F.col("conv_id") % 2 == 0, "BAB I > Pasal 3").otherwise("11. Umum")
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    return rows.select("conv_id", (F.col("turn") + F.col("place")).alias("turn"), F.concat(F.lit("S"), "place").alias("source_id"), F.col("place").cast("long"), (F.col("turn") + 1).alias("page"), path.alias("path"), "text")


def _checked(spark, sf_dir):
    return answers.verified(answers.claims(_answers(spark, sf_dir), KEYS), _evidence(spark, sf_dir), KEYS)


@query(f"WITH {_CLAIMS} SELECT conv_id, turn, claim_no, claim, array_to_string(ids, ',') AS ids FROM c")
def inline_citations(spark, sf_dir):
    return answers.claims(_answers(spark, sf_dir), KEYS).select(*KEYS, "claim_no", "claim", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {_CHECKED} SELECT conv_id, turn, claim_no, status, overlap FROM checked")
def claim_verify(spark, sf_dir):
    return _checked(spark, sf_dir).select(*KEYS, "claim_no", "status", "overlap")


@query(f"""
WITH {_CHECKED} SELECT s.conv_id, s.turn, string_agg(CASE WHEN k.status = 'UNSUPPORTED' THEN '{answers.REMOVED}' ELSE s.span END, '' ORDER BY s.i) AS safe FROM s LEFT JOIN checked k USING (conv_id, turn, i) GROUP BY s.conv_id, s.turn""")
def redacted_answers(spark, sf_dir):
    return answers.redacted(_answers(spark, sf_dir), _checked(spark, sf_dir), KEYS).select(*KEYS, "safe")


@query(f"""
WITH {_CHECKED} SELECT conv_id, turn, count(*) AS n_claims, bool_or(status = 'UNSUPPORTED') AS rejected, bool_and(status = 'UNSUPPORTED') AS stream_insufficient, round(avg(CASE WHEN status = 'SUPPORTED' THEN 1 ELSE 0 END), 6) AS support_rate FROM checked GROUP BY ALL""")
def fail_closed(spark, sf_dir):
    return answers.verdicts(_checked(spark, sf_dir), KEYS)


@query(r"""
WITH """ + _A + r""", p AS (SELECT conv_id, turn, string_split_regex(text, '\[\s*(?:(?:S\d+\s*,?\s*)+)\]') AS plain, regexp_extract_all(text, '\[\s*((?:S\d+\s*,?\s*)+)\]', 1) AS marks FROM a)
SELECT conv_id, turn, i - 1 AS part, plain[i] AS text, CASE WHEN i <= len(marks) THEN array_to_string(regexp_extract_all(marks[i], 'S\d+'), ',') ELSE '' END AS ids FROM (SELECT *, unnest(range(1, len(plain) + 1)) AS i FROM p)""")
def display_parts(spark, sf_dir):
    found = _answers(spark, sf_dir).select(*KEYS, F.posexplode(answers.display_parts(F.col("text"))).alias("part", "x"))
    return found.select(*KEYS, F.col("part").cast("long"), "x.text", "x.ids")


_DEFANG = r"regexp_replace(regexp_replace({0}, '(?m)^[=\-]{{3,}}\s*$', '[quoted from document: \0]', 'g'), '(?im)^\s*(SOURCE\s+S\d+|SYSTEM|ASSISTANT|USER QUERY|CONVERSATION CONTEXT|UNTRUSTED EVIDENCE|REMINDER)\s*:?\s*$', '[quoted from document: \0]', 'g')"


@query(f"""
WITH {_A}, b AS (SELECT conv_id, turn, string_agg('SOURCE ' || source_id || chr(10) || '========' || chr(10) || 'Structural Path:' || chr(10) || path || chr(10) || chr(10) || 'Page:' || chr(10) || page || chr(10) || chr(10) || 'Original Text:' || chr(10) || {_DEFANG.format("text")}, chr(10) || chr(10) ORDER BY place) AS pack FROM ev GROUP BY ALL)
SELECT q.conv_id, q.turn, 'USER QUERY' || chr(10) || '========' || chr(10) || q.text || chr(10) || chr(10) || 'UNTRUSTED EVIDENCE' || chr(10) || '========' || chr(10) || coalesce(pack, '(no evidence found)') || chr(10) || chr(10) || '{answers.REMINDER}' AS prompt
FROM t q LEFT JOIN b USING (conv_id, turn) WHERE role = 'user'""".replace("REMINDER\n========\n", "REMINDER' || chr(10) || '========' || chr(10) || '"))
def prompt_pack(spark, sf_dir):
    """The prompt of every question over the two turns before it."""
    asked = _turns(spark, sf_dir).where("role = 'user'").select(*KEYS, F.col("text").alias("question"))
    return answers.prompts(asked, _evidence(spark, sf_dir), KEYS)


@query(rf"""
WITH m AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN '====' WHEN 1 THEN 'SOURCE S' || i || ':' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id) SELECT doc_id, {_DEFANG.format("text")} AS safe FROM d""")
def defang(spark, sf_dir):
    """Whole documents, half of whose lines pose as delimiters and headers."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, "====").when(i % 4 == 1, F.concat(F.lit("SOURCE S"), i, F.lit(":"))).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", T.defang(F.array_join(lines, "\n")).alias("safe"))


@query(f"WITH {_A} SELECT a.conv_id, a.turn, source_id, place - 1 AS place, left(ev.text, 500) AS excerpt, path FROM a JOIN ev USING (conv_id, turn)")
def message_sources(spark, sf_dir):
    """The evidence of each answer as rows: labels and texts zipped by place."""
    packs = _evidence(spark, sf_dir).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "source_id", "text", "path"))).alias("e"))
    zipped = F.arrays_zip(F.transform("e", lambda x: x["source_id"]).alias("id"), F.transform("e", lambda x: F.substring(x["text"], 1, 500)).alias("excerpt"), F.transform("e", lambda x: x["path"]).alias("path"))
    found = _answers(spark, sf_dir).select(*KEYS).join(packs, KEYS).select(*KEYS, F.posexplode(zipped).alias("n", "x"), "e")
    return found.select(*KEYS, F.col("x.id").alias("source_id"), (F.get("e", F.col("n"))["place"] - 1).alias("place"), "x.excerpt", "x.path")


_TYPES = ["AMENDS", "REPEALS", "REPLACES", "IMPLEMENTS", "REFERS_TO", "SUPERSEDED_BY"]
_REL = f"""
v AS (SELECT doc_id AS version_id, doc_id // 3 AS document_id FROM documents), d AS (SELECT doc_id // 3 AS document_id, min(source) AS title FROM documents GROUP BY 1),
r AS (SELECT doc_id AS from_version, doc_id // 2 AS to_version, ({_TYPES})[doc_id % 6 + 1] AS relation_type FROM documents)"""


def _relations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    document = F.floor(F.col("doc_id") / 3).cast("long").alias("document_id")
    versions = docs.select(F.col("doc_id").alias("version_id"), document)
    titles = docs.groupBy(document).agg(F.min("source").alias("title"))
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 6).cast("int")).alias("relation_type")
    return docs.select(F.col("doc_id").alias("from_version"), F.floor(F.col("doc_id") / 2).cast("long").alias("to_version"), kind), versions, titles


@query(f"""
WITH {_REL} SELECT t.document_id, string_agg(relation_type || ':' || f.document_id || ':' || title, ',' ORDER BY relation_type || ':' || f.document_id || ':' || title) AS warnings
FROM r JOIN v t ON t.version_id = to_version JOIN v f ON f.version_id = from_version JOIN d ON d.document_id = f.document_id WHERE relation_type IN ('AMENDS', 'REPEALS', 'REPLACES') GROUP BY 1""")
def superseding_warnings(spark, sf_dir):
    return answers.superseding(*_relations(spark, sf_dir))


@query(f"""
WITH {_REL} SELECT from_version, to_version, relation_type, f.document_id AS from_document, t.document_id AS to_document FROM r JOIN v t ON t.version_id = to_version JOIN v f ON f.version_id = from_version
JOIN d x ON x.document_id = f.document_id JOIN d y ON y.document_id = t.document_id WHERE x.title = 'src1' OR y.title = 'src1'""")
def relations_either_side(spark, sf_dir):
    relations, versions, titles = _relations(spark, sf_dir)

    def side(name):
        return versions.join(titles, "document_id").select(F.col("version_id").alias(f"{name}_version"), F.col("document_id").alias(f"{name}_document"), F.col("title").alias(f"{name}_title"))

    found = relations.join(side("from"), "from_version").join(side("to"), "to_version").where("from_title = 'src1' or to_title = 'src1'")
    return found.select("from_version", "to_version", "relation_type", "from_document", "to_document")


_RESULTS = f"""
WITH {_CHECKED}, vd AS (SELECT conv_id, turn, bool_or(status = 'UNSUPPORTED') AS got_insufficient, avg(CASE WHEN status = 'SUPPORTED' THEN 1 ELSE 0 END) AS support_rate FROM checked GROUP BY ALL),
res AS (SELECT conv_id, turn, conv_id % 4 <> 0 AS expects, CASE WHEN turn % 7 < 5 THEN turn % 7 + 1 END AS rank, conv_id % 2 = 0 AS cited, support_rate, conv_id % 4 = 0 AS expect_insufficient, got_insufficient, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'timeout' END AS error FROM vd)"""


@query(f"""
{_RESULTS} SELECT count(*) AS questions, count(error) AS errors, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END) FILTER (WHERE expects AND error IS NULL), 6) AS recall_at_5, round(avg(coalesce(1 / rank, 0)) FILTER (WHERE expects AND error IS NULL), 6) AS mrr,
  round(avg(coalesce(1 / log2(rank + 1), 0)) FILTER (WHERE expects AND error IS NULL), 6) AS ndcg_at_5, round(avg(CASE WHEN cited THEN 1 ELSE 0 END) FILTER (WHERE expects AND error IS NULL), 6) AS citation_accuracy,
  round(avg(support_rate) FILTER (WHERE expects AND error IS NULL), 6) AS citation_coverage, round(avg(CASE WHEN expect_insufficient = got_insufficient THEN 1 ELSE 0 END) FILTER (WHERE error IS NULL), 6) AS insufficient_accuracy FROM res""")
def evaluation_summary(spark, sf_dir):
    """The evaluation's metrics over all answers; ranks, expectations and errors stand in by number."""
    found = answers.verdicts(_checked(spark, sf_dir), KEYS)
    place = F.col("turn") % 7
    results = found.select(
        *KEYS, (F.col("conv_id") % 4 != 0).alias("expects"), F.when(place < 5, place + 1).alias("rank"), (F.col("conv_id") % 2 == 0).alias("cited"), "support_rate", (F.col("conv_id") % 4 == 0).alias("expect_insufficient"),
        F.col("rejected").alias("got_insufficient"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "timeout").alias("error"),
    )
    return answers.evaluation(results)


@query(f"""
WITH {laws.PATHS}, {_PARSED}, {_CHUNKS}, {_CHECKED.replace("WITH ", "")}, n AS (SELECT conv_id, turn, count(*) AS n_exact FROM hits GROUP BY ALL), vd AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_claims, bool_or(status = 'UNSUPPORTED') AS rejected FROM checked GROUP BY ALL)
SELECT q.conv_id, q.turn, CASE WHEN n_exact > 0 THEN 'EXACT_STRUCTURAL' ELSE 'HYBRID' END AS mode, coalesce(n_claims, 0) AS n_claims, CASE WHEN rejected IS NULL THEN 'NO_ANSWER' WHEN rejected THEN 'INSUFFICIENT' ELSE 'ANSWERED' END AS outcome
FROM q LEFT JOIN n USING (conv_id, turn) LEFT JOIN vd USING (conv_id, turn)""")
def turn_pipeline(spark, sf_dir):
    """Every question from its route to the verdict on the answer after it."""
    exact = retrieval.exact_counts(*_asked(spark, sf_dir), KEYS).drop("n_documents")
    judged = answers.verdicts(_checked(spark, sf_dir), KEYS).select("conv_id", (F.col("turn") - 1).alias("turn"), "n_claims", "rejected")
    joined = questions(spark, sf_dir).select(*KEYS).join(exact, KEYS, "left").join(judged, KEYS, "left")
    outcome = F.when(F.col("rejected").isNull(), "NO_ANSWER").when(F.col("rejected"), "INSUFFICIENT").otherwise("ANSWERED")
    mode = F.when(F.col("n_exact") > 0, "EXACT_STRUCTURAL").otherwise("HYBRID")
    return joined.select(*KEYS, mode.alias("mode"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), outcome.alias("outcome"))
