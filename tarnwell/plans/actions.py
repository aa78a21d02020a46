"""What to do with decided files: planned as rows, without touching any file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.plans.rules import Rule, RuleSet
from tarnwell.schema import DONE
from tarnwell.session import drop_table, materialize


@dataclass(frozen=True)
class Place:
    """Where outputs go, and the roots that inputs come from."""

    output: str
    trash: str
    roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Action:
    """A kind of action: the columns ``directory`` and ``filename`` of its target (None: it plans nothing).

    ``named`` targets get names that don't collide; ``consumes`` says that the original doesn't stay; ``tracked`` outputs
    are recorded and pruned when no longer wanted.
    """

    name: str
    directory: Callable[[Place, Column], Column] | None
    named: bool = True
    consumes: bool = False
    tracked: bool = False


ACTIONS: dict[str, Action] = {}


def register_action(action: Action) -> None:
    """Adds a kind of action."""
    ACTIONS[action.name] = action


def _in_folder(place: Place, folder: Column) -> Column:
    return F.concat(F.lit(place.output.rstrip("/") + "/"), folder)


register_action(Action("copy", _in_folder, tracked=True))
register_action(Action("move", _in_folder, consumes=True))
register_action(Action("delete", lambda place, folder: F.lit(place.trash.rstrip("/")), named=False, consumes=True))
register_action(Action("ignore", None))


def relative_path(path: Column, roots: tuple[str, ...]) -> Column:
    """The path below the first root that holds it, else its last part."""
    out = F.element_at(F.split(path, "/"), -1)
    for root in reversed(roots):
        start = root.rstrip("/") + "/"
        out = F.when(F.startswith(path, F.lit(start)), F.substring(path, len(start) + 1, 2**31 - 1)).otherwise(out)
    return out


def _suffixed(filename: Column, image_id: Column) -> Column:
    """``stem_id.ext``; a name that begins with its only dot has no extension."""
    stem, suffix = F.regexp_extract(filename, r"^(\.*[^.].*?|\.*)(\.[^.]*)?$", 1), F.regexp_extract(filename, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.concat(stem, F.lit("_"), image_id.cast("string"), suffix)


def allocate_names(rows: DataFrame) -> DataFrame:
    """``rows`` (image_id, seq, directory, filename) with ``name``: the first of a directory's equal names keeps it.

    Others get their id before the extension. A name so made isn't checked again but is taken from then on, so a later
    file that has it by itself is suffixed too. Who is first comes from a map-side minimum, not a window, for a third of
    all files may have one name.
    """
    order = F.struct("image_id", "seq")
    first = rows.groupBy("directory", "filename").agg(F.min(order).alias("first"))
    marked = rows.join(first, ["directory", "filename"]).withColumn("keeps", order == F.col("first")).drop("first")
    held: list[DataFrame] = []
    while True:
        named = marked.withColumn("name", F.when(F.col("keeps"), F.col("filename")).otherwise(_suffixed(F.col("filename"), F.col("image_id"))))
        made = named.where("not keeps").groupBy("directory", "name").agg(F.min(order).alias("made")).withColumnRenamed("name", "filename")
        late = marked.where("keeps").join(made, ["directory", "filename"]).where(order > F.col("made")).select("image_id", "seq", F.lit(True).alias("__late"))
        if late.isEmpty():  # nearly always at once, and then nothing was written
            return named.drop("keeps")
        marked = materialize(
            marked.join(late, ["image_id", "seq"], "left").withColumn("keeps", F.col("keeps") & F.col("__late").isNull()).drop("__late"), "names"
        )
        held.append(marked)
        for old in held[:-1]:
            drop_table(old)
        held = held[-1:]


def actionable(images: DataFrame) -> DataFrame:
    """The live images that have been decided."""
    return images.where((F.col("missing") == 0) & (F.col("deleted") == 0) & (F.col("detect_state") == DONE) & F.col("category").isNotNull())


def plan_actions(images: DataFrame, rules: RuleSet, place: Place) -> DataFrame:
    """``image_id, seq, action, source, target``: every step that the rules ask for; rows whose rule is gone have none.

    An image in doubt follows the doubt rule: if that moves it, in place of its own rule's step, if it copies, before it.
    A move that would leave a file where it is is left out, though its name stays taken.
    """
    def described(rule: Rule) -> tuple[str, str, str]:
        return rule.name, rule.action, rule.target_folder

    table = images.sparkSession.createDataFrame([described(r) for r in rules.rules], "category string, action string, folder string")
    rows = actionable(images).select(F.col("id").alias("image_id"), "path", "filename", "category", (F.col("needs_review") == 1).alias("doubtful"))
    ruled = rows.join(F.broadcast(table), "category")  # as many rows as rules
    doubt = rules.doubt
    doubtful = F.col("doubtful") & F.lit(doubt.action != "ignore")
    own = ruled.where(~(doubtful & F.lit(ACTIONS[doubt.action].consumes))).withColumn("seq", F.lit(1))
    second = ruled.where(doubtful).withColumns({"seq": F.lit(0), "action": F.lit(doubt.action), "folder": F.lit(doubt.target_folder)})
    steps = own.unionByName(second)
    planning = {k: a for k, a in ACTIONS.items() if a.directory is not None}
    directory = F.coalesce(*[F.when(F.col("action") == k, a.directory(place, F.col("folder"))) for k, a in planning.items()])
    steps = materialize(steps.where(F.col("action").isin(*planning)).withColumn("directory", directory), "steps")
    fixed = [k for k, a in planning.items() if not a.named]
    names = allocate_names(steps.where(~F.col("action").isin(*fixed)))
    loose = steps.where(F.col("action").isin(*fixed)).withColumn("name", relative_path(F.col("path"), place.roots))
    placed = names.unionByName(loose).withColumn("target", F.concat("directory", F.lit("/"), "name"))
    moved_nowhere = (F.col("action") == "move") & (F.col("target") == F.col("path"))
    return placed.where(~moved_nowhere).select("image_id", "seq", "action", F.col("path").alias("source"), "target")


def dry_run(plan: DataFrame) -> DataFrame:
    """``action, n`` of a plan."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def apply_tally(results: DataFrame) -> DataFrame:
    """``outcome, action, n`` of a plan carried out, or judged by ``outcomes``; every error counts as ``error``."""
    outcome = F.when(F.startswith("outcome", F.lit("error")), "error").otherwise(F.col("outcome"))
    return results.groupBy(outcome.alias("outcome"), "action").agg(F.count(F.lit(1)).alias("n"))


def _tracked(plan: DataFrame) -> DataFrame:
    kinds = [k for k, a in ACTIONS.items() if a.tracked]
    return plan.where(F.col("action").isin(*kinds)).select(F.col("target").alias("link_path"), "image_id").distinct()


def stale_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Recorded outputs that the plan doesn't want any more, or wants for another image."""
    return links.join(_tracked(plan), ["link_path", "image_id"], "left_anti").select(*links.columns)


def existing_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned outputs that are recorded already."""
    return _tracked(plan).join(links.select("link_path", "image_id"), ["link_path", "image_id"], "left_semi")


def links_of_root(links: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """Recorded outputs of the images of one root."""
    return links.join(images.where(F.col("root") == root).select(F.col("id").alias("image_id")), "image_id", "left_semi").select(*links.columns)


def forget_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Recorded outputs without those of some paths (``link_path``)."""
    return links.join(paths.select("link_path").distinct(), "link_path", "left_anti").select(*links.columns)


def clear_links(links: DataFrame) -> DataFrame:
    """No recorded outputs; the table keeps its columns."""
    return links.where(F.lit(False))


def record_links(links: DataFrame, made: DataFrame) -> DataFrame:
    """Recorded outputs with new ones (link_path, image_id and more); the new one holds where a path is known."""
    kept = links.join(made.select("link_path").distinct(), "link_path", "left_anti").select(*links.columns)
    return kept.unionByName(made.select(*links.columns))


def outcomes(plan: DataFrame, links: DataFrame, present: DataFrame) -> DataFrame:
    """``plan`` with ``outcome`` as an execution would find it: existing, created, done or skipped (source gone).

    ``present`` has the ``path`` of every file there is.
    """
    there = present.select(F.col("path").alias("source"), F.lit(True).alias("__there")).distinct()
    known = existing_links(links, plan).select(F.col("link_path").alias("target"), "image_id", F.lit(True).alias("__known"))
    tracked = F.col("action").isin(*[k for k, a in ACTIONS.items() if a.tracked])
    both = plan.join(there, "source", "left").join(known, ["target", "image_id"], "left")
    outcome = (
        F.when(tracked & F.col("__known"), "existing").when(F.col("__there").isNull(), "skipped").when(tracked, "created").otherwise("done")
    )
    return both.select(*plan.columns, outcome.alias("outcome"))


def verify(links: DataFrame, images: DataFrame, present: DataFrame) -> DataFrame:
    """One row: how many recorded outputs are there or gone, and how many live sources are gone."""
    there = present.select("path", F.lit(1).alias("__there")).distinct()
    outputs = links.select(F.col("link_path").alias("path")).join(there, "path", "left")
    sources = images.where("missing = 0 and deleted = 0").select("path").join(there, "path", "left")
    ok = F.col("__there").isNotNull()
    both = outputs.select(ok.alias("__output"), F.lit(None).cast("boolean").alias("__source")).unionByName(sources.select(F.lit(None).cast("boolean").alias("__output"), ok.alias("__source")))
    return both.agg(F.count_if(F.col("__output")).alias("copies_ok"), F.count_if(~F.col("__output")).alias("copies_missing"), F.count_if(~F.col("__source")).alias("sources_missing"))
