"""Readings of images: replayed from a table, or made by a local model where its libraries are installed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.errors import EngineError

REQUIRED = ["config.json", "preprocessor_config.json", "tokenizer_config.json"]
LEAST_BYTES = 10**9


def replay(images: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Images with the replies recorded for them; an image without one has a null reply."""
    return images.join(replies.select(*keys, "raw_response"), keys, "left")


def model_reader(load: Callable[[], Callable[[bytes, str, int], str]], prompt: str, tokens: int) -> Callable[[Column], Column]:
    """A column function from image bytes to replies. ``load`` runs once in each worker and returns the model's call."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = load()
        for images in batches:
            yield images.map(lambda image: None if image is None else call(bytes(image), prompt, tokens))

    return read


def check_model_folder(folder: str, model_type: str | None = None) -> Path:
    """A folder that holds a whole local checkpoint."""
    path = Path(folder).expanduser().resolve()
    if missing := [name for name in REQUIRED if not (path / name).is_file()]:
        raise EngineError(f"the model folder lacks {', '.join(missing)}: {path}")
    weights = sorted(path.glob("*.safetensors"))
    if not weights or sum(w.stat().st_size for w in weights) < LEAST_BYTES:
        raise EngineError(f"the model folder has no complete weights: {path}")
    if len(weights) > 1 and not (path / "model.safetensors.index.json").is_file():
        raise EngineError(f"sharded weights need their index: {path}")
    found = json.loads((path / "config.json").read_text()).get("model_type")
    if model_type and found != model_type:
        raise EngineError(f"the model is of type {found!r}, not {model_type!r}")
    return path


PAGE_PROMPT = (
    "Look at this page of a utility plan and answer with one JSON object: contains_pole_drawing, contains_facility_ids, contains_utility_plan_sheet and contains_highlighted_pole_labels (true or false), "
    "confidence (0 to 1) and reason (a short text)."
)


def tile_prompt(shapes: Column) -> Column:
    """What a tile reader is asked, with the catalog's commonest id shapes (array of text)."""
    text = (
        'Read the pole identifiers on this part of a plan and answer with one JSON object {"candidates": [...]}, each candidate with text, label_text, context_type, confidence, complete and touches_tile_edge. '
        "Keep letters and digits as drawn. Mark ids that the edge cuts off as incomplete. Known ids look like these shapes, A for a letter and 9 for a digit: "
    )
    listed = F.concat_ws(", ", shapes)
    return F.concat(F.lit(text), F.when(listed == "", "alphanumeric IDs").otherwise(listed))
