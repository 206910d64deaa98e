"""The boundary to a detector: a Python callable over batches of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gridlark.schemas import DETECTION


def detect(images: DataFrame, factory: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Detections of ``(path, content)`` rows.

    ``factory`` makes the detector once per task; it maps an image's bytes to
    dicts with class_id, class_name, confidence and xyxy.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "detections": [detector(x) for x in batch["content"]]})

    return images.select("path", "content").mapInPandas(run, f"path string, detections array<struct<{DETECTION}>>")
