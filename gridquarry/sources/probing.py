"""Opening many slides and masks on the executors: a result for each, or the reason why there is none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridquarry.outcomes import attempted


def pyramids(manifest: DataFrame, backend: str = "pil") -> tuple[DataFrame, DataFrame]:
    """(pyramids, errors) of the slides in a manifest: sample_id, level, width, height, base_spacing_um."""

    def work(row: dict) -> pd.DataFrame:
        from gridquarry.sources.slides import Slide

        if not row["image_path"]:
            raise ValueError("a slide without a path")
        slide = Slide.open(row["image_path"], backend, row["spacing_at_level_0"])
        sizes = slide.reader.level_sizes
        return pd.DataFrame({"level": range(len(sizes)), "width": [w for w, _ in sizes], "height": [h for _, h in sizes], "base_spacing_um": slide.spacing_um})

    return attempted(manifest.select("sample_id", "image_path", "spacing_at_level_0"), "sample_id", work, "level int, width bigint, height bigint, base_spacing_um double", "pyramids")


def masks(manifest: DataFrame, backend: str, mask_w: int, mask_h: int) -> tuple[DataFrame, DataFrame]:
    """(masks, errors): sample_id, mx, my, label of the pixels that are not 0, on rasters of mask_w x mask_h by nearest pixels.

    The coarsest level that is no smaller than the raster is read, so that a task holds about one raster.
    """

    def work(row: dict) -> pd.DataFrame:
        from gridquarry.sources.slides import discrete, open_mask, resized

        if not row["mask_path"]:
            raise ValueError("a slide without a mask")
        mask = open_mask(row["mask_path"], backend, row["spacing_at_level_0"] or 1.0)
        fits = [k for k, (w, h) in enumerate(mask.reader.level_sizes) if w >= mask_w and h >= mask_h]
        labels = resized(discrete(mask.level(max(fits, default=0))), mask_w, mask_h, "nearest")
        my, mx = np.nonzero(labels)
        return pd.DataFrame({"mx": mx.astype(np.int64), "my": my.astype(np.int64), "label": labels[my, mx].astype(np.int32)})

    return attempted(manifest.select("sample_id", "mask_path", "spacing_at_level_0"), "sample_id", work, "mx bigint, my bigint, label int", "masks")
