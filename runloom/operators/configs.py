"""Checks on tables of network configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Layer types that work on images.
IMAGE_TYPES = ("CONVOLUTION", "MAXPOOL")


def _fold(network: Column, size: Column) -> Column:
    """Image size after all layers; NULL as soon as one does not divide exactly.

    A dense layer ends the image part and leaves the size as it is.
    """

    def step(acc: Column, layer: Column) -> Column:
        span = acc + layer["padding"] * 2 - layer["kernel_size"]
        fits = (span >= 0) & (F.try_mod(span, layer["stride"]) == 0)
        after = F.when(fits, F.floor(F.try_divide(span, layer["stride"])).cast("int") + 1)
        return F.when(layer["type"].isin(*IMAGE_TYPES), after).otherwise(acc)

    return F.aggregate(network, size.cast("int"), step)


def validate_configs(
    configs: DataFrame, network: str = "network", height: str = "input_image_size_y", width: str = "input_image_size_x"
) -> DataFrame:
    """Add ``out_y``, ``out_x`` and ``valid`` for each configuration row."""
    out = configs.withColumn("out_y", _fold(F.col(network), F.col(height))).withColumn(
        "out_x", _fold(F.col(network), F.col(width))
    )
    return out.withColumn("valid", F.col("out_y").isNotNull() & F.col("out_x").isNotNull())
