"""The three programs built of the operators: curation, feedback and gap filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions.jsonrepair import string_list
from loomgrain.operators import allocation, dedup, experience, frontier, gates, rounds
from loomgrain.providers import Llm
from loomgrain.runtime import staged
from loomgrain.thresholds import Settings

Stage = Callable[[DataFrame], DataFrame]


def curated(candidates: DataFrame, settings: Settings, scorers: list[tuple[str, Stage]] = (), order: str = "seq") -> DataFrame:
    """A: candidates with the columns of a quality record, ``hash`` and ``texts`` to outcomes with ``reasons`` and ``stage``.

    Dedup, quality, then the ``scorers``: (name, function that adds a column
    ``codes``), dearest last. A stage sees only the rows that passed the ones before,
    which is staged, so dear stages do not run on rejects; the reasons are those of the first stage that fails.
    """
    scope = [] if settings.dedup_scope == "global" else [settings.dedup_scope]
    d = dedup.keep_first(candidates, scope, order, settings.max_distance, name="curate-dedup")
    rows = candidates.join(d, order)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("reasons", F.when(F.col("dup_of").isNotNull(), F.array(F.lit("dedup_duplicate"))).otherwise(none))
    done = [rows.where(F.size("reasons") > 0).withColumn("stage", F.lit("dedup"))]
    live = rows.where(F.size("reasons") == 0)
    stages: list[tuple[str, Stage]] = [("quality", lambda x: x.withColumn("codes", gates.quality_codes(settings.quality))), *scorers]
    for name, run in stages:
        scored = staged(run(live.drop("codes")).withColumn("reasons", F.col("codes")).drop("codes"), f"curate-{name}")
        done.append(scored.where(F.size("reasons") > 0).withColumn("stage", F.lit(name)))
        live = scored.where(F.size("reasons") == 0)
    out = live.withColumn("stage", F.lit("accepted"))
    for x in done:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def feedback(outcomes: DataFrame, library: DataFrame, llm: Llm, settings: Settings, order: str = "seq") -> dict:
    """B: one pass of the loop over finished rounds: summaries, the experience library and the next queries.

    The tables per round are small; only the advantage of the last round goes to the model.
    """
    r = staged(rounds.with_rounds(outcomes, order, settings.round_size), "feedback-rounds")
    summary = rounds.summary(r)
    last = rounds.trend(summary).orderBy(F.desc("round_id")).limit(1).first()
    lib = experience.top_queries(experience.accumulated(library, experience.tallies(r)), settings.top_k)
    advice = last["advantage"] if last else ""
    best = [x["query"] for x in lib.limit(7).collect()]
    queries = string_list(llm.answer(f"{advice}\nBest queries: {best}\nNext queries:")) or best[:3]
    return {"summary": summary, "vector": rounds.rejection_vector(r), "library": lib, "advantage": advice, "queries": queries}


def next_frontier(spark_pairs: DataFrame, done: DataFrame, issued: DataFrame, queries: list[str], k: int = 10) -> DataFrame:
    """Strategy queries for the next open pairs, without those issued before."""
    spark = spark_pairs.sparkSession
    open_ = frontier.batch(frontier.remaining(spark_pairs.select("topic", "subtopic"), done).withColumn("pos", F.concat_ws("\u0000", "topic", "subtopic")), k)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], "at int, query string")
    return frontier.fan_out(open_, frontier.not_issued(q, issued, "at"))


def filled(pairs: DataFrame, accepted: DataFrame, target: int, plan: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], improve: Callable[[DataFrame], DataFrame], lines: DataFrame | None = None, max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """C: (needs, generated rows with reasons). Prompts for what is missing are generated and screened; failed ones are improved and tried again.

    ``plan``: needs to prompts (prompt_id, prompt); ``generate``: prompts to rows with
    prompt_id and reasons; ``improve``: failed rows to prompts. At most ``max_rounds`` rounds, each staged.
    """
    counts = staged(allocation.pair_counts(pairs, accepted), "fill-counts")
    missing = allocation.gap(counts, target).first()["gap"]
    needs = allocation.uniform(counts, missing)
    if lines is not None:
        parsed = allocation.parsed_needs(lines, pairs)
        if parsed.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0] > 0:
            needs = allocation.scaled(parsed, missing)
    prompts, done = plan(needs.where("need > 0")), None
    for i in range(max_rounds):
        got = staged(generate(prompts), f"fill-{i}")
        ok = got.where(F.size("reasons") == 0)
        done = ok if done is None else done.unionByName(ok)
        failed = got.where(F.size("reasons") > 0)
        if i == max_rounds - 1 or not failed.limit(1).count():
            done = done.unionByName(failed)
            break
        prompts = improve(failed)
    return needs, done


def screened(generated: DataFrame, settings: Settings, scorers: list[tuple[str, Stage]] = (), order: str = "seq") -> DataFrame:
    """Generated rows through quality and the ``scorers``, and dedup last, so that only good rows take a place."""
    live, done = generated, []
    for name, run in [("quality", lambda x: x.withColumn("codes", gates.quality_codes(settings.quality))), *scorers]:
        scored = staged(run(live).withColumn("reasons", F.col("codes")).drop("codes"), f"screen-{name}")
        done.append(scored.where(F.size("reasons") > 0).withColumn("stage", F.lit(name)))
        live = scored.where(F.size("reasons") == 0).drop("reasons")
    d = dedup.keep_first(live, [], order, settings.max_distance, name="screen-dedup")
    none = F.array().cast("array<string>")
    out = live.join(d, order).withColumn("reasons", F.when(F.col("dup_of").isNotNull(), F.array(F.lit("pHash_duplicate"))).otherwise(none))
    out = out.withColumn("stage", F.when(F.size("reasons") > 0, "dedup").otherwise("accepted"))
    for x in done:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def allocation_prompt(counts: DataFrame, gap: int) -> str:
    """What a model is asked to distribute a gap; one line per configured pair."""
    lines = [f"{r['topic']} {r['subtopic']}: {r['image_count']}" for r in counts.orderBy("topic", "subtopic").collect()]
    return f"{gap} images are missing. Present counts:\n" + "\n".join(lines) + "\nAnswer with one line per pair, as 'topic subtopic: number'."


def plan_prompt(topic: str, subtopic: str, need: int) -> str:
    """What a model is asked for the prompts of a pair."""
    return f"Write {need} prompts for text-rich images of '{subtopic}' in '{topic}', as a JSON array of strings."
