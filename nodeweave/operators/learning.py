"""Training rows, hash-drawn noise and samples, and the exchange of labels with a teacher.

Nothing here draws from a generator with a state: every draw is a hash of a seed and
the row's own keys, so a result does not depend on where a row stands or how
often a task runs.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.functions.text import strip_fence
from nodeweave.functions.vectors import clamp01, col, resize, traversal_scalars, vec

TARGETS = ("follow", "read_full", "include", "expand", "stop")


def edge_features(scalars: int = 2) -> Column:
    """One array of a candidate's vectors and scalars: query, current_summary, edge, dst_summary, path, confidence and hop."""
    return F.concat(*[vec(v) for v in ("query", "current_summary", "edge", "dst_summary", "path")], traversal_scalars("confidence", "hop", scalars))


def attach_features() -> Column:
    """One array of new_summary, candidate_summary, new_full, candidate_full, path."""
    return F.concat(*[vec(v) for v in ("new_summary", "candidate_summary", "new_full", "candidate_full", "path")])


def six_targets(target: Column | str) -> Column:
    """A target of six values; of five the result is the include value. Any other length fails, null stays null."""
    t = vec(target)
    six = F.when(F.size(t) == 6, t).when(F.size(t) == 5, F.concat(t, F.array(F.get(t, F.lit(2)))))
    return F.when(t.isNull(), t).otherwise(F.coalesce(six, F.raise_error(F.concat(F.lit("a target has 5 or 6 values, not "), F.size(t).cast("string"))).cast("array<double>")))


# Kinds of attach candidates that share one half with the right one.
SUMMARY_KINDS = ("hard_summary_negative", "same_full_wrong_summary_negative")
FULL_KINDS = ("hard_full_negative", "same_summary_wrong_full_negative", "path_aligned_wrong_full_negative")


def kind_weight(kind: Column | str, summary_weight: float, full_weight: float) -> Column:
    """The weight of a candidate by its kind; 1 for kinds that share no half."""
    return F.when(col(kind).isin(*SUMMARY_KINDS), F.lit(summary_weight)).when(col(kind).isin(*FULL_KINDS), F.lit(full_weight)).otherwise(1.0)


def even(seed: int, *keys: Column, part: int = 0) -> Column:
    """A number in 0..1, ends left out, by the hash of the seed and keys; ``part`` 0 to 3 gives four that are independent."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1 + 8 * part, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0


def bell(seed: int, *keys: Column) -> Column:
    """A draw of the standard normal distribution by hash."""
    return F.sqrt(-2.0 * F.log(even(seed, *keys))) * F.cos(2.0 * math.pi * even(seed, *keys, part=1))


def random_vector(key: Column | str, dims: int, seed: int = 0) -> Column:
    """Members of a random direction, not yet of length one, the same for a key everywhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: bell(seed, col(key), i))


def noisy_vector(v: Column | str, key: Column | str, noise: float, dims: int, seed: int = 0) -> Column:
    """The resized vector with noise on every member, not yet of length one."""
    if noise < 0:
        raise ValueError("noise must not be negative")
    return F.zip_with(resize(v, dims), random_vector(key, dims, seed), lambda x, z: x + noise * z)


def picked(df: DataFrame, n: int, key: str, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows of each group (of all rows without ``by``), drawn by hash of ``key``, with their ``place`` in the draw.

    A group is first cut in slots, so no task ranks a large group alone. Rows of equal keys stay in any order.
    """
    if n < 1:
        raise ValueError("n must be positive")
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_slot", F.substring("_draw", 31, 2))
    first = drawn.withColumn("place", F.row_number().over(Window.partitionBy(*(by or []), "_slot").orderBy("_draw", key))).filter(F.col("place") <= n)
    whole = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_draw", key)
    return first.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= n).drop("_draw", "_slot")


# Fixed value: the words around the task that a teacher is asked.
PROMPT = """Label each candidate for whether a deterministic graph traversal student should follow it.
Use these score meanings:
- follow: traverse this edge next.
- read_full: inspect the full destination node before deciding.
- include: include the destination node in the answer set.
- expand: continue exploring from the destination node.
- stop: stop this branch after this candidate.
Decision policy:
- Use query_intent/expected_topic as the target for this synthetic teacher task.
- A destination that matches the target topic and terms should usually receive high follow/include/expand.
- A candidate with similar words but the wrong destination topic is a hard negative: prefer read_full over follow/include.
- A bridge or expressway-style edge should get follow only when it moves toward the target topic; otherwise stop it.
- Keep follow and include separate: follow means useful next traversal step, include means useful answer node.
- Calibrate aggressively: strongest target candidates near 0.9-1.0, clear off-topic negatives near 0.0-0.1.
Return exactly: {"candidates":[{"id":"...","follow":0.0,"read_full":0.0,"include":0.0,"expand":0.0,"stop":0.0}]}.
Do not include markdown, prose, or extra keys.

Task JSON:
"""


def _said(x: Column, *names: str, **renamed: str) -> list[Column]:
    """Text fields of a struct, empty where missing."""
    return [F.coalesce(x[n], F.lit("")).alias(n) for n in names] + [F.coalesce(x[n], F.lit("")).alias(new) for new, n in renamed.items()]


def _terms(x: Column, name: str) -> Column:
    return F.coalesce(x[name], F.array().cast("array<string>")).alias(name)


def prompt_task() -> Column:
    """The task of an episode as a struct; missing texts are empty, null members of lists left out."""
    candidate = F.transform(F.filter("candidates", lambda c: c.isNotNull()), lambda c: F.struct(
        *_said(c, "id", "parent_id", "dst_id", candidate_kind="kind"), *_said(c, "source_topic"), F.coalesce(c["destination_topic"], c["node_topic"], F.lit("")).alias("destination_topic"), *_said(c, "destination_plain_topic"),
        _terms(c, "destination_terms"), *_said(c, "edge_summary"), F.coalesce(c["confidence"], F.lit(0.0)).alias("edge_confidence"), F.coalesce(c["hop"], F.lit(0)).alias("hop"), *_said(c, "retrieval_reason"),
        c["relation"].alias("relation"), *_said(c, "node_summary", "node_full"),
    ))
    step = F.transform(F.filter("path", lambda p: p.isNotNull()), lambda p: F.struct(p["node_id"].alias("node_id"), *_said(p, "summary", "topic", "plain_topic"), _terms(p, "terms")))
    node = F.col("current_node")
    return F.struct(
        F.col("id").alias("episode_id"), "query", "query_intent", F.coalesce("expected_topic", F.lit("")).alias("expected_topic"), step.alias("path"),
        F.struct(node["node_id"].alias("node_id"), *_said(node, "summary", "full", "topic", "plain_topic"), _terms(node, "terms")).alias("current_node"), candidate.alias("candidates"),
    )


def escaped(text: Column) -> Column:
    """JSON text in ASCII only: every other character written out as UTF-16 units."""
    other = re.compile("[^\x00-\x7f]")

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else other.sub(lambda m: json.dumps(m[0])[1:-1], t) for t in texts.to_pylist()], pa.string())

    return run(text)


def build_prompt() -> Column:
    """The whole prompt of an episode."""
    return F.concat(F.lit(PROMPT), escaped(F.to_json(prompt_task(), {"ignoreNullFields": "false"})))


LABELS = "struct<candidates: array<struct<id: string, follow: double, read_full: double, include: double, expand: double, stop: double>>>"


def read_labels(answers: DataFrame) -> DataFrame:
    """(id, candidate_id, the five scores) of teachers' answers (id, answer, known); known are the ids asked for.

    Fences are stripped, unknown ids passed over, scores held to 0..1; the last of a
    repeated id counts. An answer that is no such JSON gives no row (see label_faults).
    """
    got = answers.select("id", "known", F.posexplode(F.from_json(strip_fence("answer"), LABELS)["candidates"]).alias("pos", "x"))
    got = got.filter(F.array_contains("known", F.col("x.id")))
    last = got.groupBy("id", F.col("x.id").alias("candidate_id")).agg(F.max_by("x", "pos").alias("x"))
    return last.select("id", "candidate_id", *[clamp01(F.col(f"x.{t}")).alias(t) for t in TARGETS])


def label_faults(answers: DataFrame) -> DataFrame:
    """(id, missing): answers that leave out some of the ids asked for, all of them where the answer can't be read; a caller that must fail raises on any row."""
    found = read_labels(answers).filter(" and ".join(f"{t} is not null" for t in TARGETS)).select("id", "candidate_id")
    wanted = answers.select("id", F.explode(F.array_distinct(F.array_compact("known"))).alias("candidate_id"))
    return wanted.join(found, ["id", "candidate_id"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("candidate_id")).alias("missing"))


def apply_labels(episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """episodes with the labels of their candidates under qwen_teacher, rounded to six places; a candidate without a label keeps what it has, a null one stays null."""
    by_id = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("candidate_id", F.struct(*[F.round(t, 6).alias(t) for t in TARGETS], F.lit(None).cast("double").alias("result"))))).alias("labels"))
    joined = episodes.join(by_id, "id", "left")
    given = F.transform("candidates", lambda c: F.when(c.isNotNull(), F.when(F.try_element_at("labels", c["id"]).isNotNull(), c.withField("qwen_teacher", F.try_element_at("labels", c["id"]))).otherwise(c)))
    return joined.withColumn("candidates", given).drop("labels")


class Refused(Exception):
    """A teacher's answer that no repetition will change."""


def ask_teacher(prompts: DataFrame, client: Callable[[str, str], str], addresses: tuple[str, ...], retries: int = 3, wait: Callable[[int], None] = lambda attempt: None) -> DataFrame:
    """(id, answer, attempts, fault) of prompts (id, prompt): each is put to the addresses in turn until one answers.

    ``client(address, prompt)`` gives the answer or raises; ``Refused`` ends the
    prompt's attempts at once, any other fault is tried again, ``retries`` times over all
    addresses, with ``wait(attempt)`` between. A prompt that is never answered has a null answer and its last fault.
    """
    if retries < 1 or not addresses:
        raise ValueError("retries and addresses must not be empty")
    schema = T.StructType([prompts.schema["id"], T.StructField("answer", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("fault", T.StringType())])

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        tried, fault = 0, None
        for attempt in range(1, retries + 1):
            for address in addresses:
                tried += 1
                try:
                    return client(address, prompt), tried, None
                except Refused as e:
                    return None, tried, f"refused: {e}"
                except Exception as e:  # noqa: BLE001 - whatever a client raises is worth another try
                    fault = str(e)
            if attempt < retries:
                wait(attempt)
        return None, tried, fault

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(p) for p in b["prompt"]]
            yield pd.DataFrame({"id": b["id"], "answer": [g[0] for g in got], "attempts": pd.array([g[1] for g in got], "int32"), "fault": [g[2] for g in got]})

    return prompts.select("id", "prompt").mapInPandas(run, schema)
