"""Column expressions: labels, geometry, windows, weights, names and JSON records. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Process labels of artifacts that lie flat in their folder.
FLAT_LABELS = ("tissue", "merged")
#: models' other names.
ALIASES = {"hoptimus0": "h-optimus-0", "hoptimus1": "h-optimus-1", "virchow-2": "virchow2", "uni-2": "uni2", "phikon-v2": "phikonv2"}
#: Suffixes of plain rasters and of images with a resolution.
RASTER_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".webp")
SPACING_SUFFIXES = (".tif", ".tiff", ".svs", ".ndpi", ".mrxs", ".scn", ".vms", ".bif")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded as in SQL engines, half away from zero: what is below zero and rounds to it stays -0.0, which Spark's round drops."""
    return F.signum(col(x)) * F.abs(F.round(col(x), digits))


# Labels of annotation classes


def artifact_label(label: Column | str) -> Column:
    """Class of a stored artifact: null for the flat ones."""
    c = col(label)
    return F.when(c.isin(*FLAT_LABELS) | (F.trim(c) == ""), F.lit(None)).otherwise(c)


def structural_label(label: Column | str) -> Column:
    """Like artifact_label, but `tissue` stays."""
    return F.nullif(col(label), F.lit("merged"))


def blank_to_null(x: Column | str) -> Column:
    c = col(x)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def has_tiles(n: Column | str) -> Column:
    """Whether a count that may be text, null or no number is positive."""
    return F.coalesce(col(n).cast("string").try_cast("double").try_cast("int"), F.lit(0)) > 0


# Work units and names


def work_unit(sample: Column | str, label: Column | str) -> Column:
    """One text for (sample, class): the sample alone where there is no class, else a JSON pair behind a mark."""
    return F.when(col(label).isNull(), col(sample)).otherwise(F.concat(F.lit("@unit:"), F.to_json(F.array(col(sample), col(label)))))


def work_unit_parts(unit: Column | str) -> Column:
    """Struct (sample, label) of a work unit."""
    c = col(unit)
    pair = F.from_json(F.substring(c, 7, 1 << 30), "array<string>")
    return F.when(c.startswith("@unit:"), F.struct(pair[0].alias("sample"), pair[1].alias("label"))).otherwise(F.struct(c.alias("sample"), F.lit(None).cast("string").alias("label")))


def file_stem(x: Column | str) -> Column:
    """Percent-encoded, without any character that is special in paths or patterns."""
    return F.replace(F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def is_path_part(x: Column | str) -> Column:
    """Whether a text can be one part of a path."""
    c = col(x)
    return F.coalesce((c != "") & ~c.isin(".", "..") & ~c.rlike(r"[/\\\x00]"), F.lit(False))


def glob_escaped(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"([*?\[])", "[$1]")


def artifact_dir(kind: str, label: Column | str) -> Column:
    """Folder of a kind of artifacts, with a sub-folder for each class."""
    return F.concat_ws("/", F.lit(kind), artifact_label(label))


def image_paths(root: str, kind: str, sample: Column | str, suffix: str) -> Column:
    """Struct (payload, sidecar) of an image's artifact, flat in the folder of its kind; null where the sample can't be part of a path."""
    base = F.concat(F.lit(f"{root.rstrip('/')}/{kind}/"), col(sample))
    return F.when(is_path_part(sample), F.struct(F.concat(base, F.lit("." + suffix)).alias("payload"), F.concat(base, F.lit(".meta.json")).alias("sidecar")))


def tile_archive(root: Column | str, sample: Column | str) -> Column:
    """A root that is an archive holds all samples; else each has its own below it."""
    r = col(root)
    return F.when(r.endswith(".tar"), r).otherwise(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), col(sample), F.lit(".tiles.tar")))


def ranked_path(path: Column | str, rank: Column | str) -> Column:
    """A file's path with the rank before its last suffix."""
    p = col(path)
    folder, name = F.regexp_extract(p, r"^(.*/)?", 0), path_stem(p)
    return F.concat(folder, name, F.lit(".rank"), col(rank).cast("string"), F.regexp_extract(p, r"[^/](\.[^./]*)$", 1))


def positive_or_null(x: Column | str) -> Column:
    """A positive, finite number; null for any other."""
    v = col(x).cast("double")
    return F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)


def region_name(x: Column | str, y: Column | str) -> Column:
    return F.concat_ws("_", col(x).cast("string"), col(y).cast("string"))


def safe_label(x: Column | str) -> Column:
    """Lower case, runs of other than letters and digits to one dash, none at the ends; `item` if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.trim(col(x))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("item"))


def path_stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))


def reader_regime(path: Column | str) -> Column:
    s = suffix(path)
    return F.when(s.isin(*RASTER_SUFFIXES), "raster").when(s.isin(*SPACING_SUFFIXES), "spacing").otherwise("unsupported")


def model_name(x: Column | str) -> Column:
    key = F.lower(F.trim(col(x)))
    table = F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv))
    return F.coalesce(F.element_at(table, key), key)


def size_label(width: Column | str, height: Column | str) -> Column:
    w, h = col(width).cast("string"), col(height).cast("string")
    return F.when(w == h, F.concat(w, F.lit("px"))).otherwise(F.concat(w, F.lit("x"), h, F.lit("px")))


def backend(requested: Column | str, tiled: Column | str) -> Column:
    """The backend asked for unless it is auto; then the one that tiled the slide, unless that says nothing; else asap."""
    r, t = col(requested), col(tiled)
    return F.when(r != "auto", r).when(t.isNotNull() & ~t.isin("", "auto"), t).otherwise("asap")


def output_precision(asked: Column | str, compute: Column | str) -> Column:
    """fp16 or fp32 as asked; else fp16 after fp16 computation, else fp32."""
    a, c = _precision(asked), _precision(compute)
    return F.coalesce(a, F.when(c == "fp16", "fp16").otherwise("fp32"))


def _precision(x: Column | str) -> Column:
    key = F.lower(F.trim(col(x)))
    return F.when(key.isin("fp16", "float16", "half"), "fp16").when(key.isin("fp32", "float32", "float"), "fp32").when(key.isin("bf16", "bfloat16"), "bf16")


# Geometry


def scaled(x: Column | str, base: Column | str, spacing: Column | str) -> Column:
    """Coordinate at another resolution, cut to a whole number."""
    return (col(x) * col(base) / col(spacing)).cast("long")


def scaled_float32(x: Column | str, base: Column | str, requested: Column | str) -> Column:
    """Coordinate floored after a product in single precision."""
    ratio = (col(base).cast("double") / col(requested).cast("double")).cast("float")
    return F.floor(col(x).cast("float") * ratio).cast("long")


def read_size(size: Column | str, requested: Column | str, level: Column | str, tolerance: float = 0.05) -> Column:
    """Pixels to read at a level for `size` pixels at the requested spacing; the size itself within the tolerance. Halves go to even."""
    s, r, v = col(size).cast("double"), col(requested), col(level)
    return F.when(F.abs(v - r) <= tolerance * r, s).otherwise(F.bround(s * r / v)).cast("long")


def round_up(x: Column | str, multiple: Column | int) -> Column:
    m = F.lit(multiple) if isinstance(multiple, int) else multiple
    return (F.ceil(col(x) / m) * m).cast("long")


def round_to(x: Column | str, multiple: int) -> Column:
    """Nearest multiple, halves to even, one multiple at least."""
    return F.greatest(F.lit(multiple), F.bround(col(x) / multiple) * multiple).cast("long")


def dense_geometry(target: Column | str, patch: int) -> Column:
    """Struct (encoded, grid, pad): size padded up to whole patches."""
    encoded = round_up(target, patch)
    return F.struct(encoded.alias("encoded"), (encoded / patch).cast("long").alias("grid"), (encoded - col(target)).alias("pad"))


def window_starts(extent: Column | str, size: Column | str, stride: Column | str) -> Column:
    """Starts of windows that cover an extent; the last one is flush with its end."""
    e, s, d = (col(x).cast("long") for x in (extent, size, stride))
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(e - s, F.lit(0)), d)
    full = F.when(F.element_at(regular, -1) == e - s, regular).otherwise(F.array_append(regular, e - s))
    return F.when(s >= e, F.array(F.lit(0).cast("long"))).otherwise(full)


def hann(n: Column | str) -> Column:
    """Hann weights of a window of n, none of them zero."""
    c = col(n)
    return F.when(c <= 1, F.array(F.lit(1.0))).otherwise(F.transform(F.sequence(F.lit(1), c.cast("int")), lambda i: 0.5 - 0.5 * F.cos(2 * F.pi() * i / (c + 1))))


def subtiles(x: Column | str, y: Column | str, multiple: int, size: Column | str) -> Column:
    """Array of (subtile, x, y) of a region of multiple x multiple tiles, by rows."""
    if multiple < 2:
        raise ValueError("a region has two tiles a side at least")
    at = F.sequence(F.lit(0), F.lit(multiple * multiple - 1))
    return F.transform(at, lambda t: F.struct(t.alias("subtile"), (col(x) + F.pmod(t, F.lit(multiple)) * col(size)).alias("x"), (col(y) + F.floor(t / multiple) * col(size)).alias("y")))


# Vectors


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / (norm(col(a)) * norm(col(b)))


def class_and_patch_mean(tokens: Column | str, prefix: int) -> Column:
    """First token next to the mean of the tokens after the prefix ones. tokens: array of vectors."""
    t = col(tokens)
    patches = F.slice(t, prefix + 1, F.greatest(F.size(t) - prefix, F.lit(0)))
    total = F.aggregate(patches, F.transform(t[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.concat(F.transform(t[0], lambda x: x.cast("double")), F.transform(total, lambda x: x / F.size(patches)))


def softmax(scores: Column | str) -> Column:
    s = F.transform(col(scores), lambda x: F.exp(x - F.array_max(col(scores))))
    return F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, b: a + b))


# Maps


def differing_keys(recorded: Column | str, expected: Column | str) -> Column:
    """Sorted keys whose values differ between two maps; a key of one of them only differs."""
    diff = F.map_zip_with(col(recorded), col(expected), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(diff, lambda k, v: v)))


def with_label(payload: Column | str, label: Column | str, key: str = "progress_label") -> Column:
    """Adds a key to a map unless it is there or the label is null."""
    p = col(payload)
    return F.when(col(label).isNull() | F.map_contains_key(p, key), p).otherwise(F.map_concat(p, F.create_map(F.lit(key), col(label))))


def subject(label: Column | str, sample: Column | str) -> Column:
    return F.concat_ws(": ", blank_to_null(label), col(sample))
