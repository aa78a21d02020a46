"""The tables of an index."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# The states of a stage, as the state columns of ``images`` hold them.
PENDING, RUNNING, DONE, ERROR, SKIPPED = range(5)
STAGES = ("detect", "adjudicate", "analyze")


def _table(text: str) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType()}
    return StructType([StructField(n, kinds[k]) for n, k in (c.split(":") for c in text.split())])


TABLES = {
    "images": _table(
        "id:long path:string filename:string root:string hash:string phash:string size:long mtime:double width:int "
        "height:int format:string taken_at:string category:string action:string needs_review:int detect_state:int "
        "adjudicate_state:int analyze_state:int missing:int deleted:int error:string first_seen:double updated_at:double"
    ),
    "detections": _table(
        "id:long image_id:long class:string confidence:double x1:double y1:double x2:double y2:double model:string created_at:double"
    ),
    "adjudications": _table("id:long image_id:long class:string verdict:string confidence:double model:string created_at:double"),
    "metadata": _table("image_id:long json:string model:string created_at:double"),
    "links": _table("id:long image_id:long link_path:string category:string created_at:double"),
    "action_log": _table("id:long image_id:long action:string detail:string created_at:double"),
    "dupe_dismissals": _table("image_id_a:long image_id_b:long created_at:double"),
    "dupe_marks": _table("image_id:long mark:string created_at:double"),
}
#: Tables whose rows go when their image goes.
CHILDREN = ("detections", "adjudications", "metadata", "links", "action_log", "dupe_dismissals", "dupe_marks")
