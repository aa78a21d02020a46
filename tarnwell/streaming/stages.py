"""Stages as streaming queries over files: each batch is read once, its results are written under its number.

A batch that is run again after a failure overwrites what it had written, so a restart adds nothing. Batches are as large
as ``files_per_batch`` says; a stage ends when its input is used up (``availableNow``).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwell.operators import evidence, reporting, scan, semantic, state
from tarnwell.plans.rules import VIDEO, RuleSet
from tarnwell.schema import SKIPPED, TABLES
from tarnwell.session import drop_table, materialize
from tarnwell.sources import providers

#: What is recorded as the model of a video that nothing looked into.
SUFFIX_MODEL = "file-extension"
#: The place of a video's own box among those found in it.
LAST = 2**31 - 1


@dataclass
class Stopper:
    """Asks a run to end after the batch that it is at."""

    stopped: bool = False
    queries: list = field(default_factory=list)

    def stop(self) -> None:
        self.stopped = True
        for query in self.queries:
            query.stop()


def _write(df: DataFrame, folder: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def _exists(spark: SparkSession, folder: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _begun(spark: SparkSession, folder: str) -> bool:
    """Whether a batch of a stage's results has been written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    return len(done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []) > 0


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All batches of a stage's results."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def detected_batch(images: DataFrame, rules: RuleSet, make: Callable[[], providers.Detector], look_into_videos: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, decisions (with path and ``deleted`` of the images, for later stages) and errors of a batch of images that wait for detection.

    Every video also has the class ``video``; one that can't be read has only that, and isn't described later. Other
    images that can't be read are errors.
    """
    waiting = images.where(reporting.pending("detect")).withColumn("is_video", evidence.is_video(F.col("path")))
    seen = waiting.where("not is_video") if not look_into_videos else waiting
    found = materialize(providers.detect(seen, make, floor=rules.confidence_floor()).join(waiting.select("id", "is_video"), "id"), "found")  # infer once
    unread = waiting.join(found.select("id"), "id", "left_anti").select("id", "path", F.lit(True).alias("is_video"))
    errors = found.where("boxes is null and not is_video").select("id", F.col("error").alias("message"))
    real = found.where("boxes is not null").select(F.col("id").alias("image_id"), "model", F.posexplode("boxes").alias("seq", "b")).select("image_id", "seq", "b.*", "model")
    blind = found.where("boxes is null and is_video").select("id").unionByName(unread.select("id"))
    model = found.where("boxes is not null and is_video").select("id", "model").unionByName(blind.withColumn("model", F.lit(SUFFIX_MODEL)))
    zero = {c: F.lit(0.0) for c in ("x1", "y1", "x2", "y2")}
    mark = model.select(F.col("id").alias("image_id"), F.lit(LAST).alias("seq"), F.lit("video").alias("class"), F.lit(1.0).alias("confidence"), *[v.alias(c) for c, v in zero.items()], "model")
    boxes = real.unionByName(mark)
    done = found.where("boxes is not null or is_video").select(F.col("id").alias("image_id")).unionByName(unread.select(F.col("id").alias("image_id")))
    decisions = evidence.decide(done, boxes, rules).join(blind.select(F.col("id").alias("image_id"), F.lit(True).alias("b")), "image_id", "left")
    decisions = decisions.withColumn("skip_analyze", F.coalesce("b", F.lit(False))).drop("b")
    return boxes, decisions.join(waiting.select(F.col("id").alias("image_id"), "path", "deleted"), "image_id"), errors


def run_stage(
    spark: SparkSession,
    source: str,
    schema: StructType,
    checkpoint: str,
    work: Callable[[DataFrame, int], None],
    stopper: Stopper | None = None,
    files_per_batch: int = 16,
) -> None:
    """Feeds the files in ``source`` to ``work(batch, number)`` until they are used up, from where the last run ended."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if stopper is not None:
        stopper.queries.append(query)
        if stopper.stopped:
            query.stop()
    query.awaitTermination()


def run_detect(spark: SparkSession, source: str, out: str, rules: RuleSet, make: Callable[[], providers.Detector], stopper: Stopper | None = None, files_per_batch: int = 16) -> None:
    """The detection stage over files of image rows."""

    def work(batch: DataFrame, number: int) -> None:
        boxes, decisions, errors = detected_batch(batch, rules, make)
        _write(boxes, out, "boxes", number)
        _write(decisions, out, "decisions", number)
        _write(errors, out, "errors", number)

    run_stage(spark, source, TABLES["images"], f"{out}/checkpoints/detect", work, stopper, files_per_batch)


def boxes_of(spark: SparkSession, out: str, named: DataFrame) -> DataFrame:
    """All boxes of the images in ``named`` (image_id and the batch of detection that decided them)."""
    numbers = [r["batch"] for r in named.select("batch").distinct().collect()]  # at most as many as files in a batch
    boxes = read_results(spark, out, "boxes").where(F.col("batch").isin(numbers))
    return boxes.join(named.select("image_id", "batch"), ["image_id", "batch"], "left_semi").drop("batch")


def run_adjudicate(spark: SparkSession, out: str, rules: RuleSet, make: Callable[[], providers.Describer], stopper: Stopper | None = None, files_per_batch: int = 16) -> None:
    """Second opinions on the classes that detection left in doubt: verdicts, and the decisions they lead to.

    A batch names images, each of which has one decision; their boxes are read from all that detection wrote with it,
    so neither the files that boxes lie in nor the size of a batch has a say in the result. Questions that got no
    answer are written to ``adjudicate_errors`` (id, message); their images have no verdict and keep detection's decision. ``settled`` holds every image that was in doubt, asked
    about or not, with the decision that holds now; that lets it go on to be described.
    """
    if not _begun(spark, f"{out}/decisions"):
        return  # nothing has been detected yet
    schema = read_results(spark, out, "decisions").schema

    def work(batch: DataFrame, number: int) -> None:
        named = materialize(batch, "named")
        boxes = materialize(boxes_of(spark, out, named).withColumn("id", F.monotonically_increasing_id()), "boxes")
        asked = evidence.uncertain_classes(boxes, rules)
        questions = asked.join(named, "image_id").select(F.col("image_id").alias("id"), "path", F.array_join("classes", ",").alias("hint"))
        replies = materialize(providers.describe(questions, make), "replies")  # ask once
        failed = replies.where("error is not null").select("id", F.col("error").alias("message"))
        _write(failed, out, "adjudicate_errors", number)
        asked_for = asked.select(F.col("image_id").alias("id"), F.explode("classes").alias("class"))
        each = replies.where("error is null").join(asked_for, "id").select("id", semantic.verdict_on(F.col("reply"), F.col("class")).alias("v"))
        verdicts = each.select(F.col("id").alias("image_id"), "v.class", "v.verdict", F.col("v.confidence").alias("verdict_confidence"))
        _write(verdicts, out, "verdicts", number)
        settled = spark.read.parquet(f"{out}/verdicts/batch={number}")
        answered = replies.where("error is null").select(F.col("id").alias("image_id"))
        decisions = evidence.recheck(answered, boxes, settled, rules)
        _write(decisions, out, "rechecked", number)
        doubtful, anew = named.where("needs_review").withColumnRenamed("batch", "detected_in"), spark.read.parquet(f"{out}/rechecked/batch={number}")
        changed = doubtful.drop("category", "action", "needs_review").join(anew, "image_id")
        _write(changed.unionByName(doubtful.join(anew, "image_id", "left_anti")), out, "settled", number)
        drop_table(replies)
        drop_table(boxes)
        drop_table(named)

    run_stage(spark, f"{out}/decisions", schema, f"{out}/checkpoints/adjudicate", work, stopper, files_per_batch)


def run_analyze(spark: SparkSession, out: str, rules: RuleSet, make: Callable[[], providers.Describer], stopper: Stopper | None = None, files_per_batch: int = 16) -> None:
    """Descriptions of the images that the rules care about: ``metadata`` (image_id, json, model) and ``analyze_errors`` (id, message).

    Images that detection was sure of come from its decisions, those in doubt only once the second opinion has settled
    them, so one that it rescues from ``ignore`` is described and one that still waits for it stays for a later run.
    Ignored and deleted images and videos that nothing looked into are left out. The hint is what detection found.
    """
    classes = sorted(rules.required_classes() - {VIDEO})

    def describing(name: str, detected_in: str) -> Callable[[DataFrame, int], None]:
        def work(batch: DataFrame, number: int) -> None:
            rows = batch.where("not needs_review") if name == "decisions" else batch
            rows = rows.where("deleted = 0 and not skip_analyze and action <> 'ignore'")
            claimed = materialize(rows.select("image_id", "path", F.col(detected_in).alias("batch")), "claimed")
            known = evidence.hints(boxes_of(spark, out, claimed).withColumnRenamed("seq", "id"), rules)
            questions = claimed.join(known, "image_id", "left").select(F.col("image_id").alias("id"), "path", "hint")
            replies = materialize(providers.describe(questions, make), "replies")  # ask once
            read = replies.select("*", F.explode(F.array(semantic.salvage(F.col("reply")))).alias("v"))
            described = read.where("error is null and v is not null")
            _write(described.select(F.col("id").alias("image_id"), F.to_json(semantic.coerce(F.col("v"), classes)).alias("json"), "model"), out, f"metadata/of={name}", number)
            unread = F.concat(F.lit("model returned no JSON object: "), F.coalesce(F.left("reply", F.lit(200)), F.lit("")))
            failed = read.where("error is not null or v is null").select("id", F.coalesce("error", unread).alias("message"))
            _write(failed, out, f"analyze_errors/of={name}", number)
            drop_table(replies)
            drop_table(claimed)

        return work

    for name, detected_in in (("decisions", "batch"), ("settled", "detected_in")):
        if (stopper is None or not stopper.stopped) and _begun(spark, f"{out}/{name}"):
            schema = read_results(spark, out, name).schema
            run_stage(spark, f"{out}/{name}", schema, f"{out}/checkpoints/analyze-{name}", describing(name, detected_in), stopper, files_per_batch)


def run_all(steps: list[Callable[[], None]], stopper: Stopper) -> list[str]:
    """Runs stages one after another, the first one's failure being fatal, later ones' not; returns what went wrong."""
    problems: list[str] = []
    for i, step in enumerate(steps):
        if stopper.stopped:
            break
        try:
            step()
        except Exception as e:
            problems.append(f"{type(e).__name__}: {e}")
            if i == 0:
                stopper.stop()
                raise
    return problems


def run_together(steps: list[Callable[[], None]], stopper: Stopper, pause: float = 2.0) -> list[str]:
    """Runs stages at the same time, each in a thread: a later one takes up what the ones before it have written so far.

    A stage after the first is run again and again, from where it ended, until all before it had ended when it began. The
    first one's failure stops all and is raised, others' don't stop the rest; what went wrong with them is returned.
    """
    problems: list[tuple[int, BaseException]] = []
    ended = [threading.Event() for _ in steps]

    def keep_running(at: int) -> None:
        try:
            while True:
                last = all(e.is_set() for e in ended[:at])
                steps[at]()
                if last or stopper.stopped:
                    return
                time.sleep(pause)
        except Exception as e:
            problems.append((at, e))
            if at == 0:
                stopper.stop()
        finally:
            ended[at].set()

    threads = [InheritableThread(target=keep_running, args=(i,), name=f"stage-{i}") for i in range(len(steps))]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    for at, problem in problems:
        if at == 0:
            raise problem
    return [f"{type(e).__name__}: {e}" for _, e in sorted(problems, key=lambda x: x[0])]


def stage_tally(spark: SparkSession, out: str) -> DataFrame:
    """``stage, kind, value, n``: how many images each stage processed, by category or verdict, and how many failed in it."""
    rows = spark.createDataFrame([], "stage string, kind string, value string, n bigint")
    wanted = (
        ("detect", "decisions", "category"), ("detect", "errors", None), ("adjudicate", "rechecked", "category"), ("adjudicate", "verdicts", "verdict"),
        ("adjudicate", "adjudicate_errors", None), ("analyze", "metadata", None), ("analyze", "analyze_errors", None),
    )
    for stage, name, column in wanted:
        if _exists(spark, f"{out}/{name}"):
            table = read_results(spark, out, name)
            kind = column or ("error" if name.endswith("errors") else "described")
            value = F.col(column) if column else F.lit(None).cast("string")
            rows = rows.unionByName(table.groupBy(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), value.alias("value")).agg(F.count(F.lit(1)).alias("n")))
    return rows


def settle(spark: SparkSession, out: str, tables: dict[str, DataFrame], now: float) -> dict[str, DataFrame]:
    """An index after the stages whose results are in ``out``: states, decisions and errors of its images, and their rows.

    ``tables``: images, detections, adjudications, metadata. Images looked at anew give up their old boxes and verdicts
    even where nothing was found. Ids of new rows follow the greatest there is.
    """
    images, out_tables = tables["images"], dict(tables)

    def result(name: str) -> DataFrame | None:
        return read_results(spark, out, name) if _exists(spark, f"{out}/{name}") else None

    def replaced(name: str, rows: DataFrame, seen: DataFrame) -> None:
        stored = out_tables[name]
        start = stored.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0] + 1
        fresh = scan.numbered(rows, [c for c in ("image_id", "seq", "class") if c in rows.columns], start).withColumn("created_at", F.lit(now))
        shape = [(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema]
        out_tables[name] = state.replace_for_images(stored, fresh.select(*shape), seen)

    decided = result("decisions")
    if decided is not None:
        images = state.finish_detect(images, decided, now)
        skipped = decided.where("skip_analyze").select(F.col("image_id").alias("id"), F.lit(True).alias("__skip"))
        both = images.join(skipped, "id", "left")
        images = both.withColumn("analyze_state", F.when(F.col("__skip"), F.lit(SKIPPED)).otherwise(F.col("analyze_state")).cast("int")).select(*images.columns)
        replaced("detections", result("boxes"), decided)
        replaced("adjudications", result("boxes").where(F.lit(False)).select("image_id", "class"), decided)
    rechecked = result("rechecked")
    if rechecked is not None:
        images = state.finish_adjudicate(images, rechecked, now)
        said = result("verdicts").withColumnRenamed("verdict_confidence", "confidence")
        replaced("adjudications", said, rechecked)
    described = result("metadata")
    if described is not None:
        images = state.finish_analyze(images, described.select(F.col("image_id").alias("id")), now)
        stored = out_tables["metadata"]
        fresh = described.withColumn("created_at", F.lit(now)).select(*stored.columns)
        out_tables["metadata"] = state.replace_for_images(stored, fresh, described)
    for stage, name in (("detect", "errors"), ("adjudicate", "adjudicate_errors"), ("analyze", "analyze_errors")):
        failed = result(name)
        if failed is not None:
            images = state.fail(images, stage, failed.select("id", "message"), now)
    out_tables["images"] = state.sync_queues(images)
    return out_tables
