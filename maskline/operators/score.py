"""Scoring of predicted spans against gold spans, by note and by category.

Inputs: universe(model_id, pass, doc_id), the notes each model has to answer for; gold_docs(doc_id,
n_chars); gold(doc_id, span_no, start, end, code); predicted(model_id, pass, doc_id, start, end,
identifier_type). Every row of the universe with a gold note has a result, so a missing prediction is a full miss.
Texts stay out of all this.

A sweep: what belongs to a note meets in one shuffle by doc_id. Every span is two events, +1 where it starts and -1
where it ends; in the order of their places, running sums tell how many gold and predicted spans are open between
an event and the next, so covers, overlaps and what each span has of a cover are sums over one pass, whatever the
number of spans on both sides. Notes without spans are not swept: their sums are 0, and they meet the others' sums
in one more shuffle by doc_id. Bounds that are near meet in cells of a few codepoints on each side, of which a
span is in four at most and which hold at most as many different bounds as they have places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TOLERANCE
from ..functions.text import prefix
from .narrow import narrowed

KEYS = ("model_id", "pass", "doc_id")


def _together(universe: DataFrame | None, gold_docs: DataFrame | None, gold: DataFrame, predicted: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """What belongs to a note, in one table that doc_id deals: rows of a kind, with the note's length, runs and categories where they are asked for.

    touched(doc_id): the notes that count.
    """
    if touched is not None:
        universe, gold_docs, predicted = (narrowed(x, touched, ["doc_id"]) for x in (universe, gold_docs, predicted))
    run = F.struct(F.col("model_id").cast("string").alias("model_id"), F.col("pass").cast("string").alias("pass"))
    spans = [F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    code = F.col("code").cast("string").alias("code")
    number = F.col("span_no").cast("long").alias("span_no")
    parts = [
        gold.select("doc_id", F.lit("gold").alias("kind"), *spans, code, number),
        predicted.select("doc_id", F.lit("predicted").alias("kind"), *spans, F.col("identifier_type").alias("code"), run.alias("run")),
    ]
    if universe is not None:
        parts.append(universe.distinct().select("doc_id", F.lit("asked").alias("kind"), run.alias("run")))
        parts.append(gold_docs.select("doc_id", F.lit("note").alias("kind"), F.col("n_chars").cast("long").alias("n_chars")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if universe is None:
        return out
    note = Window.partitionBy("doc_id")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return out.withColumns({"n_chars": F.max("n_chars").over(note), "runs": F.collect_set(of("asked", "run")).over(note), "codes": F.collect_set(of("gold", "code")).over(note)}).where("n_chars is not null")


def _event(at: Column | str, run: Column, **counts) -> Column:
    """An event of a run; what it opens (1) or closes (-1)."""
    at = F.col(at) if isinstance(at, str) else at
    return F.struct(run["model_id"].alias("model_id"), run["pass"].alias("pass"), at.alias("at"), *[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in counts.items()])


def _swept(rows: DataFrame, of: Column, keys: list[str], *opened: str) -> DataFrame:
    """Events of `of`, an array of them for each row, swept by keys: `size`, how far it is to the next event, and the sums of `opened` so far."""
    events = rows.select("doc_id", "n_chars", F.explode(of).alias("e")).select("doc_id", "n_chars", "e.*")
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.lead("at").over(order) - F.col("at"), F.lit(0))
    return events.withColumns({"size": size, **{c: F.sum(c).over(so_far) for c in opened}})


def _while(*opened: str) -> Column:
    """Codepoints over which all of these are open."""
    on = F.lit(True)
    for c in opened:
        on = on & (F.col(c) > 0)
    return F.sum(F.when(on, F.col("size")).otherwise(0))


def char_counts(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per note: gt, pred_chars, tp, fp, fn, tn, residual and the note's length. Predictions are cut at the text's end."""
    rows = _together(universe, gold_docs, gold.where("end > start"), predicted)
    run, none = F.col("run"), F.lit(0).cast("long")
    end = F.least("end", "n_chars")
    asked = F.array(_event(none, run, g=0, p=0, asked=1))
    own = F.flatten(F.transform("runs", lambda r: F.array(_event("start", r, g=1, p=0, asked=0), _event("end", r, g=-1, p=0, asked=0))))
    said = F.array(_event("start", run, g=0, p=1, asked=0), _event(end, run, g=0, p=-1, asked=0))
    of = F.when(F.col("kind") == "asked", asked).when(F.col("kind") == "gold", own).when((F.col("kind") == "predicted") & (end > F.col("start")), said)
    sums = _swept(rows, of, list(KEYS), "g", "p").groupBy(*KEYS).agg(F.max("n_chars").alias("doc_chars"), F.max("asked").alias("asked"), _while("g").alias("gt"), _while("p").alias("pred_chars"), _while("g", "p").alias("tp"))
    gt, pc, tp = F.col("gt"), F.col("pred_chars"), F.col("tp")
    return sums.where("asked = 1").select(*KEYS, "doc_chars", gt, pc, tp, (pc - tp).alias("fp"), (gt - tp).alias("fn"), (F.col("doc_chars") - (gt + pc - tp)).alias("tn"), (gt - tp).alias("residual"))


#: Codepoints of a note: of gold, predicted, and both.
COVERS = ("gt", "pred_chars", "tp")


def _covers(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(KEYS, COVERS) of notes with spans."""
    touched = gold.select("doc_id").unionByName(predicted.select("doc_id"))
    own, docs = (narrowed(x, touched, ["doc_id"]) for x in (universe, gold_docs))
    return char_counts(own, docs, gold, predicted).select(*KEYS, *COVERS)


def _filled(universe: DataFrame, gold_docs: DataFrame, told: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """(KEYS, doc_chars, counts) for each note that has a length and is asked for; what told(KEYS, counts) has not is 0.

    A note's counts come as one row, an entry for each of its runs, so that all tables are dealt by doc_id and none moves twice.
    """
    run = lambda: F.struct(F.col("model_id").cast("string").alias("model_id"), F.col("pass").cast("string").alias("pass"))
    own = told.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(run(), F.struct(*counts)))).alias("_told"))
    docs = gold_docs.groupBy("doc_id").agg(F.max(F.col("n_chars").cast("long")).alias("doc_chars")).where("doc_chars is not null")
    asked = universe.select(run().alias("run"), "doc_id").join(docs, "doc_id").groupBy("run", "doc_id").agg(F.max("doc_chars").alias("doc_chars"))
    met = asked.join(own, "doc_id", "left").withColumn("_told", F.col("_told")[F.col("run")])
    return met.select("run.*", "doc_id", "doc_chars", *[F.coalesce(F.col("_told")[c], F.lit(0).cast("long")).alias(c) for c in counts])


def _cells(start: str, end: str, tolerance: int, near: bool) -> Column:
    """Cells of 2 * tolerance + 1 places on each side that hold these bounds, or, where near, some bounds within the tolerance."""
    width = 2 * tolerance + 1
    cell = lambda c, d: F.floor((F.col(c) + d) / width)
    sides = [F.array_distinct(F.array(*[cell(c, d) for d in ((-tolerance, tolerance) if near else (0,))])) for c in (start, end)]
    return F.flatten(F.transform(sides[0], lambda x: F.transform(sides[1], lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _close(bounds: str, tolerance: int) -> Column:
    """Whether some of these bounds are within the tolerance of the row's own."""
    return F.exists(bounds, lambda b: (F.abs(b["start"] - F.col("start")) <= tolerance) & (F.abs(b["end"] - F.col("end")) <= tolerance))


def span_hits(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per note and gold span: any, full, strict and relaxed hits, as 0 or 1."""
    rows = _together(universe, gold_docs, gold, predicted, gold)
    run, end, nothing = F.col("run"), F.least("end", "n_chars"), F.lit(None).cast("long")
    is_gold, is_said = F.col("kind") == "gold", F.col("kind") == "predicted"

    # covered: what the cover has up to a span's end, less what it has up to its start
    own = F.flatten(F.transform("runs", lambda r: F.array(_event("start", r, p=0, span_no=F.col("span_no"), edge=-1), _event("end", r, p=0, span_no=F.col("span_no"), edge=1))))
    said = F.array(_event("start", run, p=1, span_no=nothing, edge=0), _event(end, run, p=-1, span_no=nothing, edge=0))
    swept = _swept(rows, F.when(is_gold, own).when(is_said & (end > F.col("start")), said), list(KEYS), "p")
    before = Window.partitionBy(*KEYS).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    swept = swept.withColumn("upto", F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).over(before), F.lit(0)))
    covered = swept.where("span_no is not null").groupBy(*KEYS, "span_no").agg(F.sum(F.col("upto") * F.col("edge")).alias("covered"))

    # bounds: those of the predictions that share a cell with a gold span
    placed = rows.where(is_gold | is_said).select("doc_id", "kind", "start", "end", "span_no", "code", F.explode(F.when(is_gold, F.col("runs")).otherwise(F.array("run"))).alias("run"))
    placed = placed.withColumn("cell", F.explode(F.when(is_gold, _cells("start", "end", tolerance, True)).otherwise(_cells("start", "end", tolerance, False))))
    placed = placed.select("run.*", "doc_id", "kind", "start", "end", "span_no", "code", "cell")
    met = F.collect_set(F.when(is_said, F.struct("start", "end"))).over(Window.partitionBy(*KEYS, "cell"))
    near = placed.withColumn("met", met).where(is_gold).groupBy(*KEYS, "span_no", "code", "start", "end").agg(F.max(_close("met", 0).cast("int")).alias("strict"), F.max(_close("met", tolerance).cast("int")).alias("relaxed"))

    c = F.coalesce("covered", F.lit(0))
    kind = dict(gold.dtypes)
    out = near.join(covered, [*KEYS, "span_no"], "left")
    bounds = [F.col(x).cast(kind[x]).alias(x) for x in ("start", "end")]
    return out.select(*KEYS, F.col("span_no").cast(kind["span_no"]).alias("span_no"), "code", *bounds, (c > 0).cast("int").alias("any"), (c == F.greatest(F.col("end") - F.col("start"), F.lit(0))).cast("int").alias("full"), "strict", "relaxed")


def predicted_spans(gold: DataFrame, predicted: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Per note: different predicted bounds, and how many of them are near some gold span."""
    rows = _together(None, None, gold, predicted.dropDuplicates([*KEYS, "start", "end"]))
    is_gold = F.col("kind") == "gold"
    placed = rows.withColumn("cell", F.explode(F.when(is_gold, _cells("start", "end", tolerance, False)).otherwise(_cells("start", "end", tolerance, True))))
    met = F.collect_set(F.when(is_gold, F.struct("start", "end"))).over(Window.partitionBy("doc_id", "cell"))
    each = placed.withColumn("met", met).where(~is_gold).groupBy("doc_id", "run", "start", "end").agg(F.max(_close("met", tolerance).cast("long")).alias("near"))
    return each.groupBy("doc_id", "run").agg(F.count("*").alias("pred_span_count"), F.sum("near").alias("relaxed_pred")).select("run.*", "doc_id", "pred_span_count", "relaxed_pred")


def document_scores(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One wide row for each note of the universe."""
    kinds = ("any", "full", "strict", "relaxed")
    hits = (span_hits(universe, gold_docs, gold, predicted) if hits is None else hits).groupBy(*KEYS).agg(F.count("*").alias("spans"), *[F.sum(c).alias(c) for c in kinds])
    counts = (*COVERS, "spans", *kinds, "pred_span_count", "relaxed_pred")
    told = _covers(universe, gold_docs, gold, predicted).unionByName(hits, allowMissingColumns=True).unionByName(predicted_spans(gold, predicted), allowMissingColumns=True)
    told = told.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in counts])
    gt, pc, tp = F.col("gt"), F.col("pred_chars"), F.col("tp")
    made = _filled(universe, gold_docs, told, counts).withColumns({"fp": pc - tp, "fn": gt - tp, "tn": F.col("doc_chars") - (gt + pc - tp), "residual": gt - tp})
    return made.select(*KEYS, "doc_chars", *COVERS, "fp", "fn", "tn", "residual", *counts[len(COVERS) :])


def type_scores(universe: DataFrame, gold_docs: DataFrame, gold: DataFrame, predicted: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Per note and gold category that occurs in it: gt, tp (any type), tp_matched, pred_matched, fn and span hits.

    A category's predictions are those with the same leading digits, counted only in notes that have
    the category: each category of a note is swept with all its predictions.
    """
    rows = _together(universe, gold_docs, gold, predicted, gold)
    run, end, key = F.col("run"), F.least("end", "n_chars"), [*KEYS, "code"]
    own = F.flatten(F.transform("runs", lambda r: F.array(*[_event(c, r, code=F.col("code"), g=d, p=0, m=0) for c, d in (("start", 1), ("end", -1))])))
    opened = F.col("end") > F.col("start")
    alike = lambda c: (prefix(c) == prefix(F.col("code"))).cast("int")
    said = F.flatten(F.transform("codes", lambda c: F.array(*[_event(at, run, code=c, g=0, p=d, m=alike(c) * d) for at, d in ((F.col("start"), 1), (end, -1))])))
    of = F.when((F.col("kind") == "gold") & opened, own).when((F.col("kind") == "predicted") & (end > F.col("start")), said)
    sums = _swept(rows, of, key, "g", "p", "m").groupBy(*key).agg(_while("g").alias("gt"), _while("g", "p").alias("tp"), _while("g", "m").alias("tp_matched"), _while("m").alias("pred_matched"))
    # a category of a note is one that has hits, if only of empty spans
    hits = (span_hits(universe, gold_docs, gold, predicted) if hits is None else hits).groupBy(*key).agg(F.count("*").alias("spans"), *[F.sum(c).alias(c) for c in ("any", "full", "strict", "relaxed")])
    out = hits.join(sums, key, "left").na.fill(0, ["gt", "tp", "tp_matched", "pred_matched"])
    return out.withColumn("fn", F.col("gt") - F.col("tp")).select(*key, "gt", "tp", "tp_matched", "pred_matched", "fn", "spans", "any", "full", "strict", "relaxed")


def document_operations(responses: DataFrame, validated: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per note: windows, finished, usable, valid, tokens, whether validated, and whether complete.

    responses(keys, finish_reason, prompt_tokens, completion_tokens); validated(keys, envelope_usable,
    strict_schema_valid). Complete: some windows, all finished and, if any was validated, as many usable.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    asked = responses.groupBy(*keys).agg(F.count("*").alias("segments"), F.count_if(F.col("finish_reason") == "stop").alias("stop"), zero("prompt_tokens"), zero("completion_tokens"))
    seen = validated.groupBy(*keys).agg(F.count("*").alias("val_requests"), F.count_if("envelope_usable").alias("usable"), F.count_if("strict_schema_valid").alias("valid"))
    out = asked.join(seen, list(keys), "left").na.fill(0)
    have = F.col("val_requests") > 0
    done = (F.col("segments") > 0) & (F.col("stop") == F.col("segments")) & (~have | (F.col("usable") == F.col("segments")))
    return out.withColumn("have_validation", have).withColumn("complete", done)
