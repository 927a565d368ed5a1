"""Selection and checks around question synthesis: a model's outputs are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import harmonic, rank_score, recall_at_total
from ..functions.text import is_prose, label_index, squash, verdict

SURVEYS = "review|survey|overview|meta-analysis"
#: Anchors that point at the paper through one it cites.
CITING = ("relational_conjunction", "full_span")
_CUED = ("detail_cue", "content_conjunction", "context_conjunction", *CITING)
#: Which answer types an anchor goes with: a name can't be asked for where it is given.
CELLS = tuple((a, t) for a in ("named", "paraphrastic", *_CUED) for t in ("value", "abstract", "identity") if a in _CUED or t != "identity")


def primary_research(table: DataFrame) -> DataFrame:
    """Papers whose classification doesn't tell of a survey; unknown ones stay."""
    return table.filter(~F.lower(F.coalesce("classification", F.lit(""))).rlike(SURVEYS))


def with_body(texts: DataFrame, least: int) -> DataFrame:
    return texts.filter(F.length("body") >= least)


def contains(text: Column, part: Column) -> Column:
    """Whether a text has a part verbatim, but for case and white space; false for nulls."""
    return F.coalesce(F.contains(squash(text), squash(part)), F.lit(False))


def _given(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def grounded_single(t: DataFrame) -> DataFrame:
    """t with `valid` and the cited paper of each candidate question.

    Columns: question, answer, evidence, anchor, answer_type, title, body, public, cited_label and
    cited (an array of corpus_id and title).
    """
    q = squash("question")
    titled = (F.col("anchor") != "named") & F.coalesce(F.col("title") != "", F.lit(False)) & contains(F.col("question"), F.col("title"))
    chosen = F.get("cited", label_index("cited_label"))
    words = F.filter(F.split(squash(chosen["title"]), " "), lambda w: F.length(w) >= 5)
    cues = (F.coalesce(F.size(words), F.lit(0)) == 0) | F.coalesce(F.arrays_overlap(words, F.split(q, " ")), F.lit(False))
    citing = F.col("anchor").isin(*CITING)
    cited = ~citing | (chosen.isNotNull() & cues)
    short = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != "")) <= 15
    public, body, answer, evidence = (F.col(c) for c in ("public", "body", "answer", "evidence"))
    whole = F.concat_ws("\n", public, body)
    rule = (
        F.when(F.col("answer_type") == "value", contains(body, evidence) & is_prose(evidence) & short)
        .when(F.col("answer_type") == "abstract", contains(public, evidence) & contains(public, answer) & short)
        .when(F.col("answer_type") == "identity", contains(whole, evidence) & contains(whole, answer) & ~contains(F.col("question"), answer))
        .otherwise(F.lit(False))
    )
    valid = _given(F.col("question"), answer, evidence) & ~titled & cited & rule
    return t.withColumns({"valid": F.coalesce(valid, F.lit(False)), "cited_paper_id": F.when(citing, chosen["corpus_id"])})


def grounded_chain(t: DataFrame) -> DataFrame:
    """t with `valid`: answer and evidence stand in the right part of the terminal, and neither title nor answer in the question."""
    part = F.when(F.col("answer_type") == "value", F.col("body")).when(F.col("answer_type") == "abstract", F.coalesce("abstract", F.lit(""))).otherwise(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("body", F.lit(""))))
    named = F.coalesce(F.col("title") != "", F.lit(False)) & contains(F.col("question"), F.col("title"))
    valid = _given(F.col("question"), F.col("answer"), F.col("evidence"), part) & ~named & ~contains(F.col("question"), F.col("answer")) & contains(part, F.col("evidence")) & contains(part, F.col("answer"))
    return t.withColumn("valid", F.coalesce(valid, F.lit(False)))


def edge_accepted(label: Column, n_cited: Column, evidence: Column, context: Column, body: Column, match: Column) -> Column:
    """An edge counts if its label names a cited paper, the citing sentence is verbatim and was verified."""
    at = label_index(label)
    return F.coalesce((at >= 0) & (at < n_cited) & _given(evidence, context) & contains(body, evidence) & match, F.lit(False))


def distinct_questions(t: DataFrame, key: str, order: str, most: int = 3) -> DataFrame:
    """The first `most` different questions of each key, with their number."""
    first = F.row_number().over(Window.partitionBy(key, squash("question")).orderBy(order))
    once = t.withColumn("nth", first).filter("nth = 1").drop("nth")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return once.withColumn("nth", nth).filter(F.col("nth") <= most)


def valid_cells(t: DataFrame) -> DataFrame:
    cells = t.sparkSession.createDataFrame(CELLS, "anchor string, answer_type string")
    return t.join(cells, ["anchor", "answer_type"], "left_semi")


def rubric(*checks: Column) -> Column:
    """True if every check is literally true."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def grade(criteria: Column) -> Column:
    """The number of criteria that are true, 3 at most."""
    return F.least(F.lit(3), F.size(F.filter(criteria, lambda x: F.coalesce(x, F.lit(False)))))


def gold_sets(grades: DataFrame, least: int, most: int) -> DataFrame:
    """Gold sets from qa_id, corpus_id, grade and is_seed: seeds have grade 3, grade 0 goes, the number of 3s is bounded."""
    rows = grades.withColumn("grade", F.when(F.col("is_seed"), 3).otherwise(F.col("grade"))).filter("grade >= 1")
    per = rows.groupBy("qa_id", "corpus_id").agg(F.max("grade").alias("grade"))
    listed = per.groupBy("qa_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("grade")).alias("g"), "corpus_id"))).alias("l"), F.count_if(F.col("grade") == 3).alias("est_total_relevant"))
    kept = listed.filter(F.col("est_total_relevant").between(least, most))
    return kept.select("qa_id", F.transform("l", lambda x: F.struct(x["corpus_id"], (-x["g"]).alias("grade"))).alias("relevance"), "est_total_relevant")


def paper_set_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Reward of ordered submissions: sample_id and ids against sample_id, corpus_id, grade and est.

    The harmonic mean of recall among the first `est` ids and of how well the order follows the grades.
    """
    rows = predicted.select("sample_id", F.posexplode_outer(F.array_distinct("ids")).alias("pos", "corpus_id"))
    graded = rows.join(gold.select("sample_id", "corpus_id", "grade"), ["sample_id", "corpus_id"], "left")
    by = graded.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("grade", F.lit(0)).alias("g"))))), lambda x: x["g"]).alias("grades"))
    est = gold.groupBy("sample_id").agg(F.coalesce(F.max("est"), F.count_if(F.col("grade") >= 3)).alias("total"))
    joined = by.join(est, "sample_id")
    scored = joined.withColumns({"recall_at_est": recall_at_total(F.col("grades"), F.col("total")), "rank": rank_score(F.col("grades"))})
    return scored.select("sample_id", F.size("grades").alias("n_pred"), "total", F.round("recall_at_est", 6).alias("recall_at_est"), F.round("rank", 6).alias("rank"), F.round(harmonic(F.col("recall_at_est"), F.col("rank")), 6).alias("reward"))


def first_seen(hits: DataFrame, key: str, *order: str, by: str = "sample_id") -> DataFrame:
    """Each id of a sample once, with the place of its first appearance over the sample's hit lists."""
    first = hits.groupBy(by, key).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("at", key)))


def candidates(members: DataFrame, searched: DataFrame, seed: int, most: int) -> DataFrame:
    """Members first, then searched ids (corpus_id, ord), each once, without the seed, `most` at most."""
    both = members.select(F.lit(0).alias("src"), "ord", "corpus_id").union(searched.select(F.lit(1), "ord", "corpus_id")).filter(F.col("corpus_id") != seed)
    return both.groupBy("corpus_id").agg(F.min(F.struct("src", "ord")).alias("at")).orderBy("at", "corpus_id").limit(most).select("corpus_id", F.col("at.src").alias("src"), F.col("at.ord").alias("ord"))


def best_ranks(hits: DataFrame, *key: str) -> DataFrame:
    return hits.groupBy(*key).agg(F.min("rank").alias("rank"))


def not_short_cut(qa: DataFrame, start_hits: DataFrame, end_hits: DataFrame, within: int = 3) -> DataFrame:
    """qa (sample_id, start, terminal) with what was found; kept if the start is found and the terminal isn't at the top."""
    s = best_ranks(start_hits, "sample_id", "corpus_id").select("sample_id", F.col("corpus_id").alias("start"), F.col("rank").alias("s"))
    e = best_ranks(end_hits, "sample_id", "corpus_id").select("sample_id", F.col("corpus_id").alias("terminal"), F.col("rank").alias("e"))
    out = qa.join(s, ["sample_id", "start"], "left").join(e, ["sample_id", "terminal"], "left")
    found = out.withColumns({"start_found": F.col("s").isNotNull(), "terminal_found": F.coalesce(F.col("e") <= within, F.lit(False))})
    return found.select("sample_id", "start", "terminal", "start_found", "terminal_found", (F.col("start_found") & ~F.col("terminal_found")).alias("keep"))


def retrieval_ranks(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each sample the seed's rank among papers and among snippets' distinct papers.

    hits: sample_id, tool, pos (from 1), corpus_id. A paper's snippet rank counts papers, not snippets.
    """
    once = hits.groupBy("sample_id", "tool", "corpus_id").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("sample_id", "tool").orderBy("pos"))
    ranked = once.withColumn("rank", F.when(F.col("tool") == "search_snippets", place).otherwise(F.col("pos")))
    mine = seeds.select("sample_id", F.col("seed").alias("corpus_id")).join(ranked, ["sample_id", "corpus_id"], "left")
    return mine.groupBy("sample_id").agg(
        F.min(F.when(F.col("tool") == "search_papers", F.col("rank"))).cast("int").alias("paper_rank"),
        F.min(F.when(F.col("tool") == "search_snippets", F.col("rank"))).cast("int").alias("snippet_rank"),
        (F.count("rank") > 0).alias("found"),
    )


def closed_book(qa: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The questions that a model without tools was judged to answer wrongly; without a verdict a question goes.

    verdicts: sample_id and verdict, several for one sample if it was asked several times: one right answer is enough.
    """
    judged = verdicts.groupBy("sample_id").agg(F.count_if(verdict("verdict") == "Correct").alias("right"))
    return qa.join(judged.filter("right = 0").select("sample_id"), "sample_id", "left_semi")
