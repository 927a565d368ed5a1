"""Queries over transcripts, submissions and synthesis records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import synthesis, traces
from .fixtures import documents_texts, table
from .registry import query

_NL = "chr(10)"
_TRANSCRIPT = f"""CASE conv_id % 6
WHEN 0 THEN concat('x <tool_call>', {_NL}, '{{"name": "submit_answer", "arguments": {{"answer": " a', conv_id, ' "}}}}', {_NL}, '</tool_call> tail <answer>no</answer>')
WHEN 1 THEN concat('<tool_call>submit_answer', {_NL}, '<arg_key>answer</arg_key>', {_NL}, '<arg_value> g', conv_id, ' </arg_value></tool_call>')
WHEN 2 THEN concat('x <answer>first</answer> y <answer> last', conv_id, ' </answer>')
WHEN 3 THEN '<tool_call>{{"name": "search_papers", "arguments": {{"query": "q"}}}}</tool_call> none'
WHEN 4 THEN NULL ELSE concat('<tool_call>{{"name": "submit_answer", "arguments": {{"answer": "one"}}}}</tool_call><tool_call>{{"name": "submit_answer", "arguments": {{"answer": "two', conv_id, '"}}}}</tool_call>') END"""
_CONVS = f"convs AS (SELECT conv_id, {_TRANSCRIPT} AS t FROM (SELECT DISTINCT conv_id FROM conversations))"


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", f"{_TRANSCRIPT} AS t")


@query(f"""WITH {_CONVS}, x AS (SELECT conv_id, list_filter(regexp_extract_all(t, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1), lambda c: json_extract_string(c, '$.name') = 'submit_answer') AS j,
regexp_extract_all(t, '(?s)<tool_call>\\s*submit_answer\\s*\\n.*?<arg_value>\\s*(.*?)\\s*</arg_value>', 1) AS g, regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1) AS a FROM convs)
SELECT conv_id, coalesce(trim(json_extract_string(j[-1], '$.arguments.answer')), trim(g[-1]), trim(a[1])) AS answer FROM x""")
def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _transcripts(spark, sf).select("conv_id", traces.extract_answer(F.col("t")).alias("answer"))


@query(f"WITH {_CONVS} SELECT conv_id, trim(coalesce(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1)[-1], t)) AS answer FROM convs")
def last_answer_block(spark: SparkSession, sf: str) -> DataFrame:
    return _transcripts(spark, sf).select("conv_id", traces.last_block(F.col("t")).alias("answer"))


_LIST = "CASE conv_id % 5 WHEN 0 THEN concat('[', conv_id, ', 3, \"7\"]') WHEN 1 THEN concat('I found [', conv_id, ', 5] to fit') WHEN 2 THEN 'none' WHEN 3 THEN NULL ELSE '[]' END"


@query(f"""WITH c AS (SELECT conv_id, {_LIST} AS a FROM (SELECT DISTINCT conv_id FROM conversations)), p AS (SELECT conv_id, CASE WHEN a LIKE '[%' THEN a ELSE nullif(regexp_extract(a, '(?s)(\\[.*\\])', 1), '') END AS j FROM c)
SELECT conv_id, coalesce(array_to_string(list_transform(from_json(j, '["VARCHAR"]'), lambda x: x::BIGINT), ','), '') AS ids FROM p""")
def ranked_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", f"{_LIST} AS a")
    return rows.select("conv_id", F.array_join(F.transform(traces.ranked_ids(F.col("a")), lambda x: x.cast("string")), ",").alias("ids"))


_SUBMIT = """CASE conv_id % 6 WHEN 0 THEN concat('{"output": {"results": [{"paper_id": "', conv_id, '"}, {"paper_id": 5}, {"x": 1}]}}') WHEN 1 THEN concat('{"results": [{"paper_id": ', conv_id, '}]}')
WHEN 2 THEN concat('```json', chr(10), '{"paper_ids": [3, ', conv_id, ', 3]}', chr(10), '```') WHEN 3 THEN 'the papers are 1 and 2' WHEN 4 THEN NULL ELSE '{"paper_ids": ["x"]}' END"""


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN concat(conv_id, CASE WHEN conv_id = 5 THEN '' ELSE ',5' END) WHEN 1 THEN concat(conv_id, '') WHEN 2 THEN concat('3', CASE WHEN conv_id = 3 THEN '' ELSE concat(',', conv_id) END) ELSE '' END AS ids, CASE WHEN conv_id % 6 < 3 THEN 'json' ELSE 'empty' END AS how FROM c""")
def submission_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", f"{_SUBMIT} AS a").select("conv_id", traces.submission(F.col("a")).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s.ids", lambda x: x.cast("string")), ",").alias("ids"), F.col("s.how").alias("how"))


@query("SELECT conv_id, count(*)::INT AS n_turns, sum(length(text))::BIGINT AS n_chars, arg_max(role, turn) AS last_role, string_agg(substr(md5(text), 1, 6), '' ORDER BY turn) AS digest FROM conversations GROUP BY 1")
def trajectory_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.fold(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return out.select(
        "conv_id",
        "n_turns",
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(t["text"])).alias("n_chars"),
        F.element_at("turns", -1)["role"].alias("last_role"),
        F.array_join(F.transform("turns", lambda t: F.substring(F.md5(t["text"]), 1, 6)), "").alias("digest"),
    )


@query("SELECT conv_id, turn, substr(text, 1, 100) AS observation FROM conversations WHERE role = 'assistant'")
def observation_clip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", traces.clipped(F.col("text"), 100).alias("observation"))


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN concat('{\"limit\": ', conv_id, '}') WHEN 1 THEN '{\"q\": \"a\"}' ELSE '{}' END AS arguments FROM (SELECT DISTINCT conv_id FROM conversations)")
def tool_arguments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", "CASE conv_id % 3 WHEN 0 THEN concat('{\"limit\":', conv_id, '}') WHEN 1 THEN '  {\"q\": \"a\"} and more' ELSE '[1' END AS raw")
    return rows.select("conv_id", traces.tool_arguments("raw").alias("arguments"))


@query("SELECT conv_id, 'find' AS name, concat('{\"k\": ', conv_id, ', \"q\": \"deep nets\"}') AS arguments FROM (SELECT DISTINCT conv_id FROM conversations)")
def tagged_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", "concat('t <tool_call>find<arg_key>k</arg_key><arg_value>', conv_id, '</arg_value><arg_key>q</arg_key><arg_value>deep nets<|user|></arg_value>', CASE WHEN conv_id % 2 = 0 THEN '</tool_call>' ELSE '' END) AS raw")
    return rows.select("conv_id", traces.tagged_call("raw").alias("c")).select("conv_id", "c.name", "c.arguments")


@query("SELECT conv_id, 'find' AS name, concat('{\"k\": ', conv_id, ', \"ok\": true}') AS arguments, 'a  b' AS thought FROM (SELECT DISTINCT conv_id FROM conversations)")
def function_calls(spark: SparkSession, sf: str) -> DataFrame:
    raw = "CASE conv_id % 2 WHEN 0 THEN concat('a <tool_call>{\"name\": \"find\", \"arguments\": {\"ok\": true, \"k\": ', conv_id, '}}</tool_call> b') ELSE concat('a <function=find><parameter=k>', conv_id, '</parameter><parameter=ok>yes</parameter></function> b') END AS raw"
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", raw)
    return rows.select("conv_id", traces.function_call({"find": {"k": "integer", "ok": "boolean"}})("raw").alias("c")).select("conv_id", "c.name", "c.arguments", "c.thought")


_CALLS = "calls AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'search_papers' ELSE 'search_snippets' END AS tool, [(conv_id + turn * 3) % 17, (conv_id * 2 + turn) % 17] AS ids, conv_id % 5 AS seed FROM conversations)"


@query(f"""WITH {_CALLS} SELECT conv_id, count(*) FILTER (list_contains(ids, seed)) > 0 AS found, coalesce(min(turn) FILTER (list_contains(ids, seed)) + 1, count(*)) AS n_calls, arg_min(tool, turn) FILTER (list_contains(ids, seed)) AS found_via, string_agg(tool, ',' ORDER BY turn) AS tool_seq FROM calls GROUP BY 1""")
def retrieval_outcome(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CASE turn % 2 WHEN 0 THEN 'search_papers' ELSE 'search_snippets' END AS tool", "array((conv_id + turn * 3) % 17, (conv_id * 2 + turn) % 17) AS ids", "conv_id % 5 AS seed")
    return traces.retrieval_outcome(calls, "conv_id", "turn", "seed").withColumn("tool_seq", F.array_join("tool_seq", ","))


_HITS = "hits AS (SELECT conv_id AS sample_id, turn, k + 1 AS rank, (conv_id + turn * 5 + k * 7) % 23 AS corpus_id FROM conversations, range(0, 6) t(k))"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).selectExpr("conv_id AS sample_id", "turn", "CAST(k + 1 AS BIGINT) AS rank", "(conv_id + turn * 5 + k * 7) % 23 AS corpus_id")


@query(f"WITH {_HITS} SELECT sample_id, corpus_id, min(rank) AS rank FROM hits GROUP BY ALL")
def best_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.best_ranks(_hits(spark, sf), "sample_id", "corpus_id")


@query(f"""WITH {_HITS}, qa AS (SELECT DISTINCT conv_id AS sample_id, conv_id % 23 AS start, (conv_id * 3 + 1) % 23 AS terminal FROM conversations),
s AS (SELECT sample_id, corpus_id, min(rank) AS rank FROM hits WHERE turn % 2 = 0 GROUP BY ALL), e AS (SELECT sample_id, corpus_id, min(rank) AS rank FROM hits WHERE turn % 2 = 1 GROUP BY ALL)
SELECT qa.*, s.rank IS NOT NULL AS start_found, coalesce(e.rank <= 3, false) AS terminal_found, s.rank IS NOT NULL AND NOT coalesce(e.rank <= 3, false) AS keep FROM qa LEFT JOIN s ON s.sample_id = qa.sample_id AND s.corpus_id = start LEFT JOIN e ON e.sample_id = qa.sample_id AND e.corpus_id = terminal""")
def not_short_cut(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf)
    qa = hits.select("sample_id").distinct().selectExpr("sample_id", "sample_id % 23 AS start", "(sample_id * 3 + 1) % 23 AS terminal")
    return synthesis.not_short_cut(qa, hits.filter("turn % 2 = 0"), hits.filter("turn % 2 = 1"))


@query(f"""WITH {_HITS}, h AS (SELECT sample_id, CASE WHEN turn % 2 = 0 THEN 'search_papers' ELSE 'search_snippets' END AS tool, turn * 6 + rank AS pos, corpus_id FROM hits), o AS (SELECT sample_id, tool, corpus_id, min(pos) AS pos FROM h GROUP BY ALL),
r AS (SELECT *, CASE WHEN tool = 'search_snippets' THEN row_number() OVER (PARTITION BY sample_id, tool ORDER BY pos) ELSE pos END AS rank FROM o), q AS (SELECT DISTINCT sample_id, sample_id % 19 AS seed FROM hits)
SELECT q.sample_id, min(rank) FILTER (tool = 'search_papers')::INT AS paper_rank, min(rank) FILTER (tool = 'search_snippets')::INT AS snippet_rank, count(rank) > 0 AS found FROM q LEFT JOIN r ON r.sample_id = q.sample_id AND r.corpus_id = seed GROUP BY 1""")
def retrieval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).selectExpr("sample_id", "CASE WHEN turn % 2 = 0 THEN 'search_papers' ELSE 'search_snippets' END AS tool", "turn * 6 + rank AS pos", "corpus_id")
    return synthesis.retrieval_ranks(hits, hits.select("sample_id").distinct().selectExpr("sample_id", "sample_id % 19 AS seed"))


@query(f"WITH {_HITS}, f AS (SELECT corpus_id, min(turn * 100 + rank) AS o FROM hits WHERE sample_id = 3 GROUP BY 1) SELECT corpus_id, row_number() OVER (ORDER BY o, corpus_id)::INT AS place FROM f")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.first_seen(_hits(spark, sf).filter("sample_id = 3"), "corpus_id", "turn", "rank").select("corpus_id", "place")


@query(f"WITH {_HITS}, b AS (SELECT 0 AS src, turn * 100 + rank AS ord, corpus_id FROM hits WHERE sample_id = 1 UNION ALL SELECT 1, turn * 100 + rank, corpus_id FROM hits WHERE sample_id = 2), f AS (SELECT corpus_id, min(src * 100000 + ord) AS o FROM b WHERE corpus_id <> 4 GROUP BY 1 ORDER BY 2, 1 LIMIT 15) SELECT corpus_id, (o // 100000)::INT AS src, o % 100000 AS ord FROM f")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).withColumn("ord", F.col("turn") * 100 + F.col("rank"))
    return synthesis.candidates(hits.filter("sample_id = 1"), hits.filter("sample_id = 2"), 4, 15)


_ITEMS = """SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, concat('Title: ', split_part(text, chr(10), 1)) AS public,
CASE doc_id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'abstract' ELSE 'identity' END AS answer_type, CASE doc_id % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'full_span' ELSE 'paraphrastic' END AS anchor,
split_part(text, ' ', 3) AS answer, CASE WHEN doc_id % 7 = 0 THEN 'not in the text at all ever' ELSE replace(split_part(text, chr(10), CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END), ' ', '  ') END AS evidence,
CASE WHEN doc_id % 5 = 0 THEN concat('what of ', split_part(text, chr(10), 1)) ELSE concat('what is it about cited workings ', doc_id) END AS question, CASE doc_id % 8 WHEN 1 THEN 'C1' WHEN 5 THEN 'C9' ELSE NULL END AS cited_label FROM documents"""
_N = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _has(t: str, p: str) -> str:
    return f"coalesce(contains({_N.format(t)}, {_N.format(p)}), false)"


@query(f"""WITH i AS ({_ITEMS}) SELECT doc_id, trim(question) <> '' AND trim(answer) <> '' AND trim(evidence) <> '' AND NOT (anchor <> 'named' AND title <> '' AND {_has('question', 'title')}) AND (anchor <> 'full_span' OR coalesce(cited_label = 'C1', false)) AND
CASE answer_type WHEN 'value' THEN {_has('body', 'evidence')} AND len(list_filter(regexp_split_to_array(evidence, '\\s+'), lambda x: x <> '')) >= 6 AND len(list_filter(regexp_split_to_array(evidence, '\\s+'), lambda x: regexp_matches(x, '\\p{{L}}'))) >= 0.6 * len(list_filter(regexp_split_to_array(evidence, '\\s+'), lambda x: x <> ''))
WHEN 'abstract' THEN {_has('public', 'evidence')} AND {_has('public', 'answer')} ELSE {_has('public || chr(10) || body', 'evidence')} AND {_has('public || chr(10) || body', 'answer')} AND NOT {_has('question', 'answer')} END AS valid, CASE WHEN anchor = 'full_span' AND cited_label = 'C1' THEN doc_id + 1 END AS cited_paper_id FROM i""")
def grounded_single(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").selectExpr(*[c.strip() for c in _columns(_ITEMS)])
    cited = F.array(F.struct((F.col("doc_id") + 1).alias("corpus_id"), F.lit("Cited workings of it").alias("title")))
    return synthesis.grounded_single(items.withColumn("cited", cited)).select("doc_id", "valid", "cited_paper_id")


def _columns(select: str) -> list[str]:
    """The column expressions of a plain SELECT list; commas within parentheses part nothing."""
    inner, depth, out, at = select.split("SELECT", 1)[1].rsplit("FROM documents", 1)[0], 0, [], 0
    for k, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(inner[at:k])
            at = k + 1
    return [*out, inner[at:]]


@query(f"""WITH i AS ({_ITEMS}), h AS (SELECT *, CASE answer_type WHEN 'value' THEN body WHEN 'abstract' THEN public ELSE title || chr(10) || public || chr(10) || body END AS hay FROM i)
SELECT doc_id, trim(question) <> '' AND trim(answer) <> '' AND trim(evidence) <> '' AND trim(hay) <> '' AND NOT (title <> '' AND {_has('question', 'title')}) AND NOT {_has('question', 'answer')} AND {_has('hay', 'evidence')} AND {_has('hay', 'answer')} AS valid FROM h""")
def grounded_chain(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").selectExpr(*[c.strip() for c in _columns(_ITEMS)]).withColumnRenamed("public", "abstract")
    return synthesis.grounded_chain(items).select("doc_id", "valid")


@query(f"WITH i AS ({_ITEMS}) SELECT doc_id, coalesce(CASE cited_label WHEN 'C1' THEN true WHEN 'C9' THEN false END AND trim(evidence) <> '' AND {_has('body', 'evidence')} AND doc_id % 3 <> 0, false) AS accepted FROM i")
def edge_gate(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").selectExpr(*[c.strip() for c in _columns(_ITEMS)])
    return items.select("doc_id", synthesis.edge_accepted(F.col("cited_label"), F.lit(4), F.col("evidence"), F.lit("a context"), F.col("body"), F.col("doc_id") % 3 != 0).alias("accepted"))


@query("WITH q AS (SELECT doc_id // 8 AS paper, doc_id AS ord, concat(' What  OF ', doc_id % 5, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END) AS question FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY paper, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) ORDER BY ord) AS k FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY ord) AS nth FROM n WHERE k = 1) SELECT paper, ord, nth::INT AS nth FROM r WHERE nth <= 3")
def distinct_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr("doc_id div 8 AS paper", "doc_id AS ord", "concat(' What  OF ', doc_id % 5, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END) AS question")
    return synthesis.distinct_questions(rows, "paper", "ord").select("paper", "ord", "nth")


@query("WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'detail_cue' ELSE 'unknown' END AS anchor, CASE doc_id % 2 WHEN 0 THEN 'identity' ELSE 'value' END AS answer_type FROM documents) SELECT * FROM c WHERE anchor = 'detail_cue' OR (anchor = 'named' AND answer_type = 'value')")
def valid_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'detail_cue' ELSE 'unknown' END AS anchor", "CASE doc_id % 2 WHEN 0 THEN 'identity' ELSE 'value' END AS answer_type")
    return synthesis.valid_cells(rows).select("doc_id", "anchor", "answer_type")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.readers import pending

    done = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    attempted = done.filter("id % 2 = 0").union(done.filter("id % 2 = 1")).distinct()
    return pending(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", attempted)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN concat('a ``` b ', doc_id) ELSE concat('sum ', doc_id) END AS unfenced,
CASE doc_id % 4 WHEN 0 THEN concat('d', doc_id, ' "b"') WHEN 1 THEN concat('x', doc_id) WHEN 2 THEN concat(chr(39), 'u', doc_id, '"') ELSE concat('it', chr(39), 's ', doc_id) END AS unquoted,
concat(doc_id, doc_id % 7) AS digits, concat('plain ', doc_id) AS plain FROM documents""")
def answer_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 3 WHEN 0 THEN concat('```text\\nsum ', doc_id, '\\n``` ') WHEN 1 THEN concat(' sum ', doc_id) ELSE concat('a ``` b ', doc_id) END AS f",
        """CASE doc_id % 4 WHEN 0 THEN concat("'d", doc_id, ' "b"', "'") WHEN 1 THEN concat('"x', doc_id, '"') WHEN 2 THEN concat("'u", doc_id, '"') ELSE concat("it's ", doc_id) END AS q""",
        "concat('CorpusId: ', doc_id, '-', doc_id % 7) AS d",
        "concat('plain ', doc_id, CASE WHEN doc_id % 2 = 0 THEN '<|observation|> ' ELSE '' END) AS p",
    )
    return rows.select("doc_id", text.unfenced("f").alias("unfenced"), text.unquoted("q").alias("unquoted"), text.digits_only("d").alias("digits"), traces.plain_argument(F.col("p")).alias("plain"))


@query("WITH v AS (SELECT conv_id AS sample_id, count(*) FILTER (lower(trim(text)) LIKE 'a%') AS hits FROM conversations GROUP BY 1) SELECT DISTINCT c.conv_id AS sample_id FROM conversations c JOIN v ON v.sample_id = c.conv_id WHERE c.conv_id % 10 <> 9 AND hits = 0")
def closed_book(spark: SparkSession, sf: str) -> DataFrame:
    """Asked once a turn; sessions that end in 9 were never judged."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id AS sample_id", "CASE WHEN lower(trim(text)) LIKE 'a%' THEN ' Correct ' WHEN turn % 2 = 0 THEN 'incorrect' END AS verdict")
    return synthesis.closed_book(turns.select("sample_id").distinct(), turns.filter("sample_id % 10 <> 9"))


@query(f"WITH {_HITS}, f AS (SELECT sample_id, corpus_id, min(turn * 100 + rank) AS o FROM hits GROUP BY ALL) SELECT sample_id, corpus_id, row_number() OVER (PARTITION BY sample_id ORDER BY o, corpus_id)::INT AS place FROM f")
def first_seen_all(spark: SparkSession, sf: str) -> DataFrame:
    """Of all samples at once."""
    return synthesis.first_seen(_hits(spark, sf), "corpus_id", "turn", "rank").select("sample_id", "corpus_id", "place")


@query("SELECT doc_id, array_to_string(list_distinct(list_concat([doc_id, doc_id % 7], CASE WHEN doc_id % 3 = 0 THEN [] ELSE [doc_id % 7, doc_id % 5] END)).list_sort(), ',') AS ids FROM documents")
def backfilled_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr("doc_id", "array(doc_id, doc_id % 7) AS submitted", "CASE WHEN doc_id % 3 <> 0 THEN array(doc_id % 7, doc_id % 5) END AS searched")
    return rows.select("doc_id", F.array_join(F.sort_array(traces.backfilled_ids(F.col("submitted"), F.col("searched"))).cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'a, 2' ELSE 'plain' END AS gold FROM documents")
def gold_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 2 WHEN 0 THEN \"['a', 2]\" ELSE 'plain' END AS g").select("doc_id", traces.canonical_gold("g").alias("gold"))


@query("SELECT doc_id, concat('what is ', doc_id) AS content, lang AS ground_truth, 'qa' AS data_source, (doc_id % 3)::INT AS n_seeds FROM documents")
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    qa = documents_texts(spark, sf).select("corpus_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("corpus_id"), "lang"), "corpus_id")
    rows = qa.selectExpr("corpus_id AS sample_id", "concat('what is ', corpus_id) AS question", "lang AS answer", "'value' AS answer_type", "CASE corpus_id % 3 WHEN 0 THEN NULL WHEN 1 THEN array(corpus_id) ELSE array(corpus_id, 1L) END AS seed_paper_ids")
    out = traces.training_rows(rows, "qa", "tool_agent")
    return out.select(F.col("extra_info.sample_id").alias("doc_id"), F.get("prompt", F.lit(0))["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), "data_source", F.size("extra_info.seed_paper_ids").alias("n_seeds"))


@query("SELECT conv_id, sum(turn * 10 + length(role))::BIGINT AS prompt_tokens, sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END)::BIGINT AS completion_tokens FROM conversations GROUP BY 1")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn * 10 + length(role) AS prompt_tokens", "CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS completion_tokens")
    return traces.token_totals(turns, "conv_id")


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN concat('search_snippets:q', conv_id, ':2001|search_papers:x:') ELSE '' END AS queries FROM (SELECT DISTINCT conv_id FROM conversations)")
def search_query_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = """CASE conv_id % 3 WHEN 0 THEN concat('[{"tool": "search_snippets", "query": " q', conv_id, ' ", "year_min": 2001}, {"tool": "other", "query": "x", "venue": ""}, {"query": " "}, {"query": "fourth"}]') WHEN 1 THEN 'none' END AS raw"""
    rows = table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", raw)
    each = F.transform(traces.search_queries(F.col("raw"), 3), lambda x: F.concat(x["tool"], F.lit(":"), x["query"], F.lit(":"), F.coalesce(x["year_min"].cast("string"), F.lit(""))))
    return rows.select("conv_id", F.array_join(each, "|").alias("queries"))
