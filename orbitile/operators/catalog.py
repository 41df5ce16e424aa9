"""The asset catalog: file names parsed, dispatched, rebuilt and filtered.

One grammar per kind of file. A grammar is a pattern over the base name, the fields of
its groups, a template that rebuilds the name, and the folders of its archive path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = r"([^_]+)_([^_]+)_([^_]+)"
SCENE = r"^([^_]+)_([^_]+)_(\d+)_(\S+)_(\S+)_(\d{4})_(\d+)_(\d+)_(\d)"
REGIONS = r"((?U:[\w\s'])+)"  # names joined by underscores, which are word characters
LAYER = "red|blue|green|nir|osm-water|osm-boundary|elevation|slope"
MODEL = rf"^{REGIONS}_(resnet\d+)_r(\d+\.\d+)_ts(\d+)_({LAYER})_({LAYER})?_?({LAYER})?_?epoch(\d+)_?(best)?"
MODEL_FIELDS = ("regions", "architecture", "ratio", "tile_size", "layer_1", "layer_2", "layer_3", "epoch", "best")


@dataclass(frozen=True)
class Grammar:
    kind: str
    pattern: str
    fields: tuple[str, ...]
    template: str
    folders: tuple[str, ...]

    def matches(self, name: Column) -> Column:
        """Whether a name is of this kind; its fixed ends are compared before the pattern is tried."""
        begin, end = self.template.partition("{")[0], self.template.rpartition("}")[2]
        out = name.rlike(self.pattern)
        if end and self.pattern.endswith("$"):
            out = F.endswith(name, F.lit(end)) & out
        return F.startswith(name, F.lit(begin)) & out if begin else out

    def groups(self, name: Column) -> Column:
        """The groups of a name that matches, null where a group is missing: the name is matched once for all of them."""
        apart = GAP.join(f"${i + 1}" for i in range(len(self.fields)))
        whole = F.regexp_replace(name, self.pattern.removesuffix("$") + "(?s:.*)$", apart)
        return F.transform(F.split(whole, GAP), lambda x: F.nullif(x, F.lit("")))


#: Stands between the groups of a matched name; no file name holds it.
GAP = "\u0001"


#: Kinds in the order in which a name is tried against them (fixed values).
GRAMMARS = (
    Grammar("optical_composite", rf"^optical_composite_{PLACE}_([a-zA-Z0-9]{{3}}(?:_[a-zA-Z0-9]{{3}})*)\.tif$", ("region", "district", "mgrs", "bands"), "optical_composite_{region}_{district}_{mgrs}_{bands}.tif", ("composites", "region", "district")),
    Grammar("optical_composite_slice", rf"^optical_composite_slice_{PLACE}_([^_]+)_(\d+)_(\d+)\.tif$", ("region", "district", "mgrs", "band", "top_bound", "bottom_bound"), "optical_composite_slice_{region}_{district}_{mgrs}_{band}_{top_bound}_{bottom_bound}.tif", ("composites", "region", "district", "mgrs")),
    Grammar("multivariate_composite", rf"^multivariate_composite_{PLACE}\.tif$", ("region", "district", "mgrs"), "multivariate_composite_{region}_{district}_{mgrs}.tif", ("composites", "region", "district")),
    Grammar("sentinel2_tile", SCENE + r"_(B\d{2})\.jp2$", ("region", "district", "utm_code", "latitude_band", "square", "year", "month", "day", "sequence", "band"), "{region}_{district}_{utm_code}_{latitude_band}_{square}_{year}_{month}_{day}_{sequence}_{band}.jp2", ("sentinel2", "region", "district", "grid", "date")),
    Grammar("sentinel2_cloud", SCENE + r"_qi_MSK_CLOUDS_(B\d{2}).gml", ("region", "district", "utm_code", "latitude_band", "square", "year", "month", "day", "sequence", "band"), "{region}_{district}_{utm_code}_{latitude_band}_{square}_{year}_{month}_{day}_{sequence}_qi_MSK_CLOUDS_{band}.gml", ("sentinel2", "region", "district", "grid", "date")),
    Grammar("elevation", r"^elevation_([^_]+)_([^_]+)_([^_]{5})\.tif$", ("region", "district", "mgrs"), "elevation_{region}_{district}_{mgrs}.tif", ("elevation", "region", "district")),
    Grammar("slope", r"^slope_([^_]+)_([^_]+)_([^_]{5})\.tif$", ("region", "district", "mgrs"), "slope_{region}_{district}_{mgrs}.tif", ("slope", "region", "district")),
    Grammar("osm", r"^osm_([^_]+)_([^_]+)_([^_]{5})\.tif$", ("region", "district", "mgrs"), "osm_{region}_{district}_{mgrs}.tif", ("osm", "region", "district")),
    Grammar("single_region_tile_match", r"^sr_tile_match_([^_]+)_?([^_]+)?_?([^_]+)?_(\d+)\.csv$", ("region", "district", "mgrs", "tile_size"), "sr_tile_match_{region}_{district}_{mgrs}_{tile_size}.csv", ("tiles", "region", "district", "mgrs")),
    Grammar("multi_region_tile_match", rf"^mr_tile_match_{REGIONS}_(\d+)\.csv$", ("regions", "tile_size"), "mr_tile_match_{regions}_{tile_size}.csv", ("multi_region_tile_match",)),
    Grammar("tile", r"^([^_]+)_([^_]+)_([^_]+)_(\d+)_(\d+)_(\d+)\.tif$", ("region", "district", "mgrs", "tile_size", "x_min", "y_min"), "{region}_{district}_{mgrs}_{tile_size}_{x_min}_{y_min}.tif", ("tiles", "region", "district", "mgrs", "tile_size")),
    Grammar("tensor", r"^([^_]+)_([^_]+)_([^_]+)_(\d+)_(\d+)_(\d+)\.pt$", ("region", "district", "mgrs", "tile_size", "x_min", "y_min"), "{region}_{district}_{mgrs}_{tile_size}_{x_min}_{y_min}.pt", ("tiles", "region", "district", "mgrs", "tile_size")),
    Grammar("trained_model", MODEL + r"\.tar$", MODEL_FIELDS, "{model}.tar", ("trained_models", "regions", "architecture", "r_ratio")),
    Grammar("inference_results_csv", MODEL + r"\.csv$", MODEL_FIELDS, "{model}.csv", ("inference_results", "regions", "architecture", "r_ratio")),
    Grammar("inference_results_shapefile", MODEL + r"\.shp$", MODEL_FIELDS, "{model}.shp", ("inference_results", "regions", "architecture", "r_ratio", "shape_folder")),
    Grammar("inference_results_tarfile", MODEL + r"_shapefile\.tar$", MODEL_FIELDS, "{model}_shapefile.tar", ("inference_results", "regions", "architecture", "r_ratio")),
    Grammar("train_split", rf"^train_{REGIONS}_(\d+)_ts(\d+)\.csv$", ("regions", "ratio", "tile_size"), "train_{regions}_{ratio}_ts{tile_size}.csv", ("tiles/train_validate_splits",)),
    Grammar("validate_split", rf"^validate_{REGIONS}_(\d+)_ts(\d+)\.csv$", ("regions", "ratio", "tile_size"), "validate_{regions}_{ratio}_ts{tile_size}.csv", ("tiles/train_validate_splits",)),
)
TEXT_FIELDS = ("region", "district", "mgrs", "band", "bands", "regions", "architecture", "layer_1", "layer_2", "layer_3", "latitude_band", "square")
INT_FIELDS = ("utm_code", "year", "month", "day", "sequence", "tile_size", "x_min", "y_min", "top_bound", "bottom_bound", "epoch")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kind_of(name: Column) -> Column:
    """First kind whose grammar matches; null for none."""
    return F.coalesce(*[F.when(g.matches(name), F.lit(g.kind)) for g in GRAMMARS])


def parse(assets: DataFrame) -> DataFrame:
    """``assets(path)`` with kind and typed fields; fields a kind does not have are null."""
    out = computed_once(assets.withColumn("name", base_name(F.col("path"))), kind=kind_of(F.col("name")))
    # the groups of the one grammar that matched, by one more match, then fields by their place in it
    groups = [F.when(F.col("kind") == g.kind, g.groups(F.col("name"))) for g in GRAMMARS]
    # a one-row generator: filters on parsed fields stay above it and copy no patterns
    out = computed_once(out, _groups=F.coalesce(*groups))

    def field(f: str) -> Column:
        places: dict[int, list[str]] = {}
        for g in GRAMMARS:
            if f in g.fields:
                places.setdefault(g.fields.index(f), []).append(g.kind)
        return F.coalesce(*[F.when(F.col("kind").isin(kinds), F.get("_groups", F.lit(i))) for i, kinds in places.items()])

    cols = {f: field(f) for f in TEXT_FIELDS} | {f: field(f).cast("int") for f in INT_FIELDS}
    models = [g.kind for g in GRAMMARS if "best" in g.fields]
    out = out.withColumns(cols | {"ratio": field("ratio").cast("double"), "best": F.when(F.col("kind").isin(models), field("best").isNotNull())}).drop("_groups")
    out = out.withColumn("layers", F.when(F.col("layer_1").isNotNull(), F.array_compact(F.array("layer_1", "layer_2", "layer_3"))))
    out = out.withColumn("acq_date", F.when(F.col("year").isNotNull(), F.expr("try_make_timestamp(year, month, day, 0, 0, 0)").cast("date")))
    # a slice whose top is not above its bottom is not a slice
    return out.withColumn("kind", F.when((F.col("kind") == "optical_composite_slice") & (F.col("top_bound") > F.col("bottom_bound")), None).otherwise(F.col("kind")))


def ci_sort(items: Column) -> Column:
    """Array of strings in case-insensitive order; equal but for case: by case."""
    pairs = F.array_sort(F.transform(items, lambda x: F.struct(F.lower(x).alias("low"), x.alias("item"))))
    return F.transform(pairs, lambda p: p["item"])


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator: what reads them later copies no expression."""
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(made)))


def named_values(rows: DataFrame, value: str) -> DataFrame:
    """Adds _a and _b, 128 bits that name a nested value."""
    return rows.withColumns({"_a": F.xxhash64(value), "_b": F.xxhash64(F.lit(1), value)})


def with_sorted(parsed: DataFrame) -> DataFrame:
    """Adds the joined, case-insensitively sorted lists that names are built from."""
    joined = {f"_{c}": F.array_join(ci_sort(F.split(c, "_")), "_") for c in ("regions", "bands")}
    out = computed_once(parsed, **joined, _layers=F.array_join(ci_sort(F.col("layers")), "_"), _best=F.when(F.col("best"), "_best").otherwise(""))
    stem = F.concat("_regions", F.lit("_"), "architecture", F.lit("_r"), "ratio", F.lit("_ts"), "tile_size", F.lit("_"), "_layers", F.lit("_epoch"), "epoch", "_best")
    return computed_once(out, _model=stem)


def _piece(field: str) -> Column:
    if field in ("model", "regions", "bands"):
        return F.col(f"_{field}")
    if field == "ratio":
        return F.col("ratio").cast("int").cast("string")
    return F.col(field).cast("string")


def _filled(template: str) -> Column:
    """Template with its fields; a missing field goes with the underscore after it."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        if text:
            out.append(F.lit(text))
        if rest.startswith("_") and field in ("district", "mgrs"):
            out.append(F.coalesce(F.concat(_piece(field), F.lit("_")), F.lit("")))
            rest = rest[1:]
        else:
            out.append(_piece(field))
    return F.concat(*out, F.lit(rest))


def _named(parsed: DataFrame) -> DataFrame:
    """The sorted lists and ``rebuilt``."""
    return computed_once(with_sorted(parsed), rebuilt=F.coalesce(*[F.when(F.col("kind") == g.kind, _filled(g.template)) for g in GRAMMARS]))


def with_names(parsed: DataFrame) -> DataFrame:
    """Adds ``rebuilt``: the canonical name from the parsed fields."""
    return _named(parsed).select(*parsed.columns, "rebuilt")


def with_paths(parsed: DataFrame, root: str = "data") -> DataFrame:
    """Adds ``archive_path`` and ``remote_key`` (the path below the root)."""
    special = {
        "grid": F.concat(F.col("utm_code"), "latitude_band", "square"),
        "date": F.concat_ws("_", "year", "month", "day"),
        "r_ratio": F.concat(F.lit("r"), F.col("ratio")),
        "regions": F.col("_regions"),
        "shape_folder": F.concat("_layers", F.lit("_epoch"), "epoch", "_best", F.lit("_shapefile")),
    }
    columns = set(parsed.columns)

    def folder(g: Grammar) -> Column:
        parts = [F.lit(f) if i == 0 else special[f] if f in special else F.col(f).cast("string") if f in columns else F.lit(f) for i, f in enumerate(g.folders)]
        return F.concat_ws("/", *parts, "rebuilt")

    key = F.coalesce(*[F.when(F.col("kind") == g.kind, folder(g)) for g in GRAMMARS])
    out = computed_once(_named(parsed), remote_key=key).withColumn("archive_path", F.concat(F.lit(root + "/"), "remote_key"))
    return out.select(*parsed.columns, "rebuilt", "remote_key", "archive_path")


def round_trip(parsed: DataFrame) -> DataFrame:
    """Assets whose rebuilt name differs from their own."""
    return with_names(parsed).filter("kind is not null and rebuilt <> name")


def pick(parsed: DataFrame, *kinds: str, mgrs=None, bands=None, regions=None, layers=None, best=None, **equal) -> DataFrame:
    """Assets of some kinds under AND-ed filters, sorted by path.

    Text filters compare without case; ``mgrs`` is a list; ``bands``, ``regions`` and
    ``layers`` are equal as sets of names; ``best=True`` keeps best models, otherwise all;
    a null field never equals a given value; a value of None filters nothing.
    """
    out = parsed.filter(F.col("kind").isin(*kinds))
    if mgrs is not None:
        out = out.filter(F.lower("mgrs").isin([m.lower() for m in mgrs]))
    if bands is not None:
        out = out.filter(F.array_join(ci_sort(F.split("bands", "_")), "_") == "_".join(sorted(bands, key=str.lower)))
    if regions is not None:
        out = out.filter(F.lower("regions") == "_".join(sorted(regions, key=str.lower)).lower())
    if layers is not None:
        out = out.filter(F.array_sort("layers") == F.array_sort(F.array(*map(F.lit, layers))))
    if best:
        out = out.filter("best")
    for field, value in equal.items():
        if value is not None:
            out = out.filter(F.lower(field) == value.lower() if isinstance(value, str) else F.col(field) == value)
    return out.orderBy("path")


def district_grids(parsed: DataFrame) -> DataFrame:
    """Grids present for each district."""
    grid = F.coalesce("mgrs", F.concat(F.col("utm_code"), "latitude_band", "square"))
    return parsed.select("region", "district", grid.alias("grid")).filter(F.col("grid").rlike(r"^\d{2}[A-Za-z]{3}")).distinct()


def key_to_asset(keys: DataFrame, region: str, district: str) -> DataFrame:
    """Object keys of scene files as local asset names, with their kind."""
    flat = F.replace(F.replace(F.replace(F.replace("object_key", F.lit("/qi/"), F.lit("/")), F.lit("_qi_"), F.lit("")), F.lit("/"), F.lit("_")), F.lit("tiles_"), F.lit(""))
    named = keys.filter(~F.contains("object_key", F.lit("/preview/"))).withColumn("name", F.concat_ws("_", F.lit(region), F.lit(district), flat))
    return named.withColumn("kind", kind_of(F.col("name"))).filter("kind is not null")
