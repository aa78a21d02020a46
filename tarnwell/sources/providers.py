"""Models behind a hook: a provider is made once per partition and gets batches of rows."""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators import semantic

Box = dict


class Detector(Protocol):
    """Finds boxes; None for what it couldn't read, an empty list for what shows nothing.

    One that can look into videos has a second method, ``frames(path)``: the boxes of each sampled frame, None if no frame
    could be read.
    """

    model: str

    def detect(self, paths: Sequence[str]) -> list[list[Box] | None]: ...


class Describer(Protocol):
    """Answers in text."""

    model: str

    def describe(self, path: str, hint: str | None) -> str: ...


BOXES = "array<struct<class:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"


def merged_frames(frames: Sequence[Sequence[Box]]) -> list[Box]:
    """One set of boxes for the frames of a video (a handful), as ``evidence.merge_frames`` has it, strongest class first.

    Per class those of the frame that has most of it, then the most confident one, then comes first.
    """
    best: dict[str, tuple[tuple, list[Box]]] = {}
    for number, boxes in enumerate(frames):
        by_class: dict[str, list[Box]] = {}
        for box in boxes:
            by_class.setdefault(box["class"].lower(), []).append(box)
        for cls, own in by_class.items():
            strength = (len(own), max(b["confidence"] for b in own), -number)
            if cls not in best or strength > best[cls][0]:
                best[cls] = (strength, own)
    return [box for _, own in sorted(best.values(), key=lambda x: x[0][:2], reverse=True) for box in own]


def _tidy(boxes: Sequence[Box], floor: float) -> list[Box]:
    """Boxes from the least confidence worth keeping, classes in lower case, corners at two digits."""
    kept = (b for b in boxes if b["confidence"] >= floor)
    return [{**b, "class": b["class"].lower(), **{k: round(float(b[k]), 2) for k in ("x1", "y1", "x2", "y2")}} for b in kept]


def detect(images: DataFrame, make: Callable[[], Detector], batch: int = 16, floor: float = 0.0) -> DataFrame:
    """``id, path, boxes, model, error`` of each image (id, path, and ``is_video`` if there are videos).

    Boxes are null with an error where a file couldn't be read; those below ``floor`` (``RuleSet.confidence_floor``) are
    left out. Videos go to the provider's ``frames``, one by one, if it has that, else they are read as pictures are. A
    provider that raises fails its batch's rows or its video, not the job. Filter before calling: nothing is pushed below
    a provider.
    """

    def photos(detector: Detector, paths: list[str]) -> tuple[list, list]:
        try:
            found = detector.detect(paths)
        except Exception as e:  # one bad batch must not end the run
            return [None] * len(paths), [str(e)[:500]] * len(paths)
        return found, ["unreadable image" if f is None else None for f in found]

    def video(detector: Detector, path: str) -> tuple[list | None, str | None]:
        try:
            frames = detector.frames(path)
        except Exception as e:
            return None, str(e)[:500]
        return (merged_frames(frames), None) if frames else (None, "no readable frame")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = None
        for frame in parts:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                detector = detector or make()
                moving = list(part["is_video"]) if hasattr(detector, "frames") else [False] * len(part)
                results: list = [video(detector, p) if v else None for p, v in zip(part["path"], moving)]
                still = [i for i, v in enumerate(moving) if not v]
                if still:
                    for i, *result in zip(still, *photos(detector, [part["path"].iloc[i] for i in still])):
                        results[i] = result
                boxes = [None if f is None else _tidy(f, floor) for f, _ in results]
                yield pd.DataFrame({"id": part["id"], "path": part["path"], "boxes": boxes, "model": detector.model, "error": [e for _, e in results]})

    rows = images if "is_video" in images.columns else images.withColumn("is_video", F.lit(False))
    return rows.select("id", "path", "is_video").mapInPandas(run, f"id bigint, path string, boxes {BOXES}, model string, error string")


def describe(images: DataFrame, make: Callable[[], Describer]) -> DataFrame:
    """``id, reply, model, error`` of each image (id, path, hint)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = None
        for frame in frames:
            describer = describer or (make() if len(frame) else None)
            replies, errors = [], []
            for path, hint in zip(frame["path"], frame["hint"]):
                try:
                    replies.append(describer.describe(path, hint))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"id": frame["id"], "reply": replies, "model": describer.model if describer else None, "error": errors})

    return images.select("id", "path", "hint").mapInPandas(run, "id bigint, reply string, model string, error string")


class ChatModel:
    """A describer that asks a model behind a chat interface over HTTP.

    ``ask`` turns the hint of a picture to the question and the schema of its answer; ``read`` gives a file's picture in
    base64, as small as the model needs it. No answer, or one that isn't a reply, is an error of that picture alone.
    """

    def __init__(self, url: str, model: str, ask: Callable[[str | None], tuple[str, dict]], read: Callable[[str], str], timeout: float = 120.0) -> None:
        self.url, self.model, self._ask, self._read, self.timeout = url.rstrip("/"), model, ask, read, timeout

    def describe(self, path: str, hint: str | None) -> str:
        question, schema = self._ask(hint)
        body = json.dumps(semantic.request(self.model, question, schema, self._read(path))).encode()
        asked = urllib.request.Request(f"{self.url}/api/chat", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            return (json.load(answer).get("message") or {}).get("content") or ""


def file_in_base64(path: str) -> str:
    """A picture as it is."""
    with open(path, "rb") as file:
        return base64.b64encode(file.read()).decode()


def analyst(url: str, model: str, classes: Sequence[str], read: Callable[[str], str] = file_in_base64) -> ChatModel:
    """The model that describes pictures; the hint is what a detector found."""
    return ChatModel(url, model, lambda hint: (semantic.description_prompt(classes, hint), semantic.reply_schema(classes)), read)


def judge(url: str, model: str, read: Callable[[str], str] = file_in_base64) -> ChatModel:
    """The model that gives second opinions; the hint names the classes in doubt, parted by commas."""

    def ask(hint: str | None) -> tuple[str, dict]:
        classes = [c for c in (hint or "").split(",") if c]
        return semantic.verdict_prompt(classes), semantic.verdict_schema(classes)

    return ChatModel(url, model, ask, read)


class FakeDetector:
    """Boxes that follow from the path alone, for tests and dry runs."""

    model = "fake-detector"

    def __init__(self, classes: Sequence[str] = ("cat", "dog", "person"), unreadable: str = "broken") -> None:
        self.classes, self.unreadable = tuple(classes), unreadable

    def detect(self, paths: Sequence[str]) -> list[list[Box] | None]:
        return [self._one(p) for p in paths]

    def _one(self, path: str) -> list[Box] | None:
        if self.unreadable in path:
            return None
        digest = hashlib.sha256(path.encode()).digest()
        picked = [(self.classes[digest[i] % len(self.classes)], digest[i + 8] / 255) for i in range(digest[0] % 4)]
        return [{"class": c, "confidence": x, "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0} for c, x in picked]


class FakeDescriber:
    """A reply that repeats the hint."""

    model = "fake-describer"

    def describe(self, path: str, hint: str | None) -> str:
        return json.dumps({"activities": [], "environment": hint or "", "is_main_subject": True, "quality": 5, "notes": ""})
