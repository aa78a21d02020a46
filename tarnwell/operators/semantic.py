"""Replies of models: objects salvaged from prose, brought to the agreed shape, searched and summarised; all in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tarnwell.index import VERDICTS, bare
from tarnwell.index import verdict as read_verdict

# The fields that every reply has, whatever classes it was asked about, with their types.
SHARED = {
    "activities": ArrayType(StringType()),
    "environment": StringType(),
    "is_main_subject": BooleanType(),
    "quality": IntegerType(),
    "notes": StringType(),
}


def reply_type(classes: Sequence[str]) -> StructType:
    """The type of a reply in its agreed shape: count and kinds of each class, then the shared fields."""
    own = [f for c in classes for f in (StructField(f"{c}_count", IntegerType()), StructField(f"{c}_kinds", ArrayType(StringType())))]
    return StructType([*own, *(StructField(n, t) for n, t in SHARED.items())])


def reply_schema(classes: Sequence[str]) -> dict:
    """The JSON schema that asks a model for such a reply."""
    kinds = {"type": "array", "items": {"type": "string"}}
    fields = {k: v for c in classes for k, v in ((f"{c}_count", {"type": "integer", "minimum": 0}), (f"{c}_kinds", kinds))}
    fields |= {"activities": kinds, "environment": {"type": "string"}, "is_main_subject": {"type": "boolean"}}
    fields |= {"quality": {"type": "integer", "minimum": 0, "maximum": 10}, "notes": {"type": "string"}}
    return {"type": "object", "properties": fields, "required": list(fields)}


def verdict_schema(classes: Sequence[str]) -> dict:
    """The JSON schema that asks for a verdict and its confidence on each class."""
    fields: dict = {}
    for c in classes:
        fields[f"{c}_verdict"] = {"type": "string", "enum": ["present", "absent", "unsure"]}
        fields[f"{c}_confidence"] = {"type": "number", "minimum": 0, "maximum": 1}
    return {"type": "object", "properties": fields, "required": list(fields)}


def _one_of(names: Sequence[str], word: str) -> str:
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} {word} {names[-1]}"


def description_prompt(classes: Sequence[str], hint: str | None = None) -> str:
    """What a model is asked that describes a picture; the hint is what a detector found in it, as ``hints`` writes it."""
    shown = f" It may show {_one_of(list(classes), 'or')}." if classes else ""
    fields = ", ".join(reply_schema(classes)["properties"])
    found = f" A detector has found: {hint}. Take this as likely." if hint else ""
    return f"Describe this picture.{shown}{found} Answer with one JSON object and nothing else; its fields are {fields}."


def verdict_prompt(classes: Sequence[str]) -> str:
    """What a model is asked that gives a second opinion on whether a picture shows some classes."""
    asked = _one_of(list(classes), "and")
    words = _one_of(list(VERDICTS), "or")
    return f"Look for {asked} in this picture. Say of each whether it is {words}, and how sure you are from 0 to 1. Answer with one JSON object and nothing else."


def request(model: str, prompt: str, schema: dict, picture: str, context: int = 4096, keep_alive: str = "5m") -> dict:
    """A chat request with one picture (in base64) that asks for a reply of a schema, as repeatable as the model can be."""
    # The fields of the chat protocol.
    return {
        "model": model, "messages": [{"role": "user", "content": prompt, "images": [picture]}], "format": schema,
        "stream": False, "keep_alive": keep_alive, "options": {"temperature": 0, "num_ctx": context},
    }


def salvage(text: Column) -> Column:
    """The JSON object in a reply as a variant: the whole text, else from the first ``{`` to the last ``}``; null if none.

    A text that is JSON but no object has none either.
    """
    whole = F.try_parse_json(F.trim(text))
    part = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    found = F.when(whole.isNotNull(), whole).otherwise(part)
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def _get(value: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$['{field}']", kind)


def as_int(value: Column, field: str) -> Column:
    """A field as an integer: numbers and texts of numbers cut towards zero, true 1, anything else 0."""
    number = F.coalesce(_get(value, field, "string").try_cast("double"), _get(value, field, "boolean").cast("int").cast("double"))
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 2**31)
    return F.coalesce(F.when(usable, number.cast("int")), F.lit(0))


def as_texts(value: Column, field: str) -> Column:
    """A field as a list of trimmed texts without blanks; one text is a list of one, anything else an empty list."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
    items = F.when(F.startswith(kind, F.lit("ARRAY")), _get(value, field, "array<string>")).when(kind == "STRING", F.array(_get(value, field, "string")))
    return F.coalesce(F.filter(F.transform(items, bare), lambda x: x != ""), F.array().cast("array<string>"))


def as_text(value: Column, field: str) -> Column:
    """A field as a trimmed text; null and what is false give an empty one."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
    return F.when(truth(value, field), bare(F.coalesce(_get(value, field, "string"), F.lit("")))).otherwise(F.when(kind == "STRING", bare(_get(value, field, "string"))).otherwise(""))


def truth(value: Column, field: str) -> Column:
    """Whether a field is anything but null, false, zero, an empty text, list or object; the text "false" is true."""
    inner = F.try_variant_get(value, f"$['{field}']", "variant")
    kind, text = F.schema_of_variant(inner), _get(value, field, "string")
    number = text.try_cast("double")
    return (
        F.when(inner.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.coalesce(_get(value, field, "boolean"), F.lit(False)))
        .when(kind == "STRING", F.coalesce(text != "", F.lit(False)))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~F.to_json(inner).isin("[]", "{}"))
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def coerce(value: Column, classes: Sequence[str]) -> Column:
    """A salvaged object in the agreed shape (``reply_type``); null where there is none."""
    fields = [f for c in classes for f in (as_int(value, f"{c}_count").alias(f"{c}_count"), as_texts(value, f"{c}_kinds").alias(f"{c}_kinds"))]
    shared = [
        as_texts(value, "activities").alias("activities"),
        as_text(value, "environment").alias("environment"),
        truth(value, "is_main_subject").alias("is_main_subject"),
        F.greatest(F.lit(0), F.least(F.lit(10), as_int(value, "quality"))).alias("quality"),
        as_text(value, "notes").alias("notes"),
    ]
    return F.when(value.isNotNull(), F.struct(*fields, *shared))


def coerced_replies(df: DataFrame, key: str, text: str, classes: Sequence[str]) -> DataFrame:
    """``key`` and the fields of each reply in its agreed shape; replies without an object are left out."""
    found = df.select(key, F.explode(F.array(salvage(F.col(text)))).alias("v")).where("v is not null")
    return found.select(key, F.explode(F.array(coerce(F.col("v"), classes))).alias("r")).select(key, "r.*")


def parse_verdicts(text: Column, classes: Sequence[str]) -> Column:
    """The verdicts of a reply as an array of (class, verdict, confidence); whatever can't be read is ``unsure``, 0."""
    value = salvage(text)

    def one(c: str) -> Column:
        said = _get(value, f"{c}_confidence", "string").try_cast("double")
        sure = F.when(F.isnan(said), 0.0).otherwise(F.coalesce(said, F.lit(0.0)))
        return F.struct(
            F.lit(c).alias("class"),
            read_verdict(_get(value, f"{c}_verdict", "string")).alias("verdict"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"),
        )

    return F.array(*[one(c) for c in classes])


def verdict_on(text: Column, cls: Column) -> Column:
    """The verdict of a reply on the class in a column, as a struct of class, verdict and confidence; see ``parse_verdicts``."""
    fields = F.from_json(F.to_json(salvage(text)), "map<string,string>")
    said = F.try_element_at(fields, F.concat(cls, F.lit("_confidence"))).try_cast("double")
    sure = F.when(F.isnan(said), 0.0).otherwise(F.coalesce(said, F.lit(0.0)))
    return F.struct(
        cls.alias("class"),
        read_verdict(F.try_element_at(fields, F.concat(cls, F.lit("_verdict")))).alias("verdict"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"),
    )


def highlights(df: DataFrame, text: str, classes: Sequence[str]) -> Column:
    """What a search shows of a reply: the kinds of each class, sorted by class, then the activities."""
    value = salvage(F.col(text))
    joined = lambda f: F.when(F.size(as_texts(value, f)) > 0, F.array_join(as_texts(value, f), ", "))
    kinds = [F.concat(F.lit(f"{c}: "), joined(f"{c}_kinds")) for c in sorted(classes)]
    return F.array_compact(F.array(*kinds, joined("activities")))
