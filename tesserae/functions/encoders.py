"""Contracts of known encoders. Weights and model code are not part of the engine: `make` is plugged in by the user."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.registry import TOLERANCE, Encoder, Registry

# Level, name, variants with dimensions (the default first), input px, patch px, spacings, precision, tile encoder, any input size.
KNOWN = """
tile    conch           default=512                       448 16 0.5             fp32 -        yes
tile    conchv15        default=768                       448 16 0.5             fp16 -        yes
tile    dinov2-vitb14   default=768                       224 14 -               fp16 -        yes
tile    genbio-pathfm   default=4608                      224 16 0.5             fp32 -        yes
tile    gigapath        default=1536                      256 16 0.5             fp16 -        yes
tile    gpfm            default=1024                      224 14 0.5             fp32 -        yes
tile    h-optimus-0     default=1536                      224 14 0.5             fp16 -        yes
tile    h-optimus-1     default=1536                      224 14 0.5             fp16 -        yes
tile    h0-mini         cls_patch_mean=1536,cls=768       224 14 0.5             fp16 -        yes
tile    hibou-b         default=768                       224 14 0.5             fp16 -        yes
tile    hibou-l         default=1024                      224 14 0.5             fp16 -        yes
tile    isight          token_mean=1024,cls=1024          336 14 0.5             fp16 -        yes
tile    lunit           default=384                       224 8  0.5             fp32 -        yes
tile    mascaret        default=1536                      224 14 0.5             fp32 -        yes
tile    midnight        default=3072                      224 14 0.25,0.5,1,2    fp16 -        yes
tile    mstar           default=1024                      224 16 0.5             fp32 -        yes
tile    musk            ms_aug=2048,cls=1024              384 16 0.25,0.5,1      fp16 -        no
tile    phaet           default=1024                      224 16 0.5             fp32 -        yes
tile    phikon          default=768                       224 16 0.5             fp32 -        yes
tile    phikonv2        default=1024                      224 16 0.5             fp32 -        yes
tile    prost40m        default=384                       224 14 0.5             fp32 -        yes
tile    rudolfv2        cls_patch_mean=3072,cls=1536      224 8  0.25,0.5,1,2    fp32 -        yes
tile    rudolfv2-b      cls_patch_mean=1536,cls=768       224 8  0.25,0.5,1,2    fp32 -        yes
tile    rudolfv2-s      cls_patch_mean=768,cls=384        224 8  0.25,0.5,1,2    fp32 -        yes
tile    uni             default=1024                      224 16 0.5             fp16 -        yes
tile    uni2            default=1536                      224 14 0.5             fp16 -        yes
tile    virchow         cls_patch_mean=2560,cls=1280      224 14 0.5             fp16 -        yes
tile    virchow2        cls_patch_mean=2560,cls=1280      224 14 0.25,0.5,1,2    fp16 -        yes
slide   gigapath-slide  default=768                       -   -  0.5             fp16 gigapath no
slide   moozy-slide     default=768                       -   -  0.5             fp32 lunit    no
slide   prism           default=1280                      -   -  0.5             fp16 virchow  no
slide   prism2          base=2560,diagnostic=3072         -   -  0.5             bf16 virchow2 no
slide   titan           default=768                       -   -  0.5             fp16 conchv15 no
patient moozy           default=768                       -   -  0.5             fp32 lunit    no
"""


def parsed(line: str) -> Encoder:
    level, name, variants, size, patch, spacings, precision, tile, variable = line.split()
    dims = {k: int(v) for k, v in (x.split("=") for x in variants.split(","))}
    number = lambda x: None if x == "-" else int(x)
    side = number(patch)
    known = () if spacings == "-" else tuple(map(float, spacings.split(",")))
    return Encoder(name, level, dims, None, number(size), side and (side, side), known, precision, None if tile == "-" else tile, variable == "yes")


def catalogue() -> Registry:
    """A new registry of the known encoders, to plug implementations in."""
    out = Registry()
    for line in KNOWN.strip().splitlines():
        out.register(parsed(line))
    return out


def plugged(registry: Registry, name: str, make) -> Encoder:
    """Gives a known encoder its implementation: a function without arguments that returns one from batches to vectors."""
    e = registry.get(name)
    registry.encoders[e.name] = replace(e, make=make)
    return registry.encoders[e.name]


def list_models(level: str | None = None) -> list[str]:
    return catalogue().names(level)


def input_size(registry: Registry, name: str, size: int) -> int:
    """The size an encoder will see, if it can: positive, its own or any where the model allows it, and of whole patches."""
    t = registry.tile_of(name)
    if size <= 0:
        raise ValueError(f"size {size} is not positive")
    if size != t.input_size and not t.variable_input:
        raise ValueError(f"{t.name} takes {t.input_size} px only")
    if t.patch and any(size % p for p in t.patch):
        raise ValueError(f"{size} px are not whole patches of {t.patch} px")
    return size


def table(spark: SparkSession, registry: Registry) -> DataFrame:
    """The registry as a table, for requests to be joined with: a row for each encoder, sizes and patches those of its tile encoder."""
    rows = []
    for e in registry.encoders.values():
        t = registry.tile_of(e.name)
        variant, dim = registry.variant(e.name)
        rows.append((e.name, e.level, t.name, variant, dim, t.input_size, *(t.patch or (None, None)), list(e.spacings or t.spacings), e.precision, t.variable_input))
    return spark.createDataFrame(rows, "encoder_name string, level string, tile_encoder string, output_variant string, dim int, input_size int, patch_height int, patch_width int, spacings array<double>, precision string, variable_input boolean")


def accepted(requests: DataFrame, registry: Registry, name: str = "encoder_name", size: str = "size_px", spacing: str = "spacing_um") -> DataFrame:
    """Requests with level, dim and the complaints of `Registry.complaints` on size and spacing, as names; no such encoder is one too.

    The registry's table is broadcast: it has a row for each registered encoder, a matter of code and not of data.
    """
    known = table(requests.sparkSession, registry).withColumnRenamed("encoder_name", "_name")
    both = requests.join(F.broadcast(known), requests[name] == F.col("_name"), "left")
    whole = F.col("patch_height").isNotNull() & (F.pmod(size, "patch_height") == 0) & (F.pmod(size, "patch_width") == 0)
    misfit = F.col("input_size").isNotNull() & (F.col(size) != F.col("input_size")) & ~(F.col("variable_input") & whole)
    off = (F.size("spacings") > 0) & ~F.exists("spacings", lambda s: F.abs(s - F.col(spacing)) <= TOLERANCE)
    found = F.array_compact(F.array(F.when(off, "spacing"), F.when(misfit, "size")))
    return both.select(*requests.columns, "level", "dim", F.when(F.col("_name").isNull(), F.array(F.lit("encoder"))).otherwise(found).alias("complaints"))
