"""Frames to regions to traces under one configuration, edits of region sets, and the configuration document."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.operators import edges, extract, filters, graph, neighbours, regions, spectrum, stack, traces

# Sections, parameters and defaults of the published parameter document.
GLOBAL = {"save_intermediate_steps": True, "load_into_mem": True} | {
    f"need_recalc_{s}_params": True for s in ("dataset", "filter", "box", "eigen", "roi_extraction")
}
DATASET = {
    "dataset_folder_path": "", "trials_loaded": [], "trials_all": [], "mask_path": "", "single_file_mode": False, "original_folder_trial_split": "",
    "slice_stack": False, "slice_every": 3, "slice_start": 0, "crop_stack": False, "crop_x": [0, 0], "crop_y": [0, 0], "trial_split": False,
    "trial_length": 400, "auto_crop": False,
}
FILTER = {
    "median_filter": False, "median_filter_size": 3, "z_score": False, "hist_eq": False, "localSpatialDenoising": True, "pca": False, "pca_threshold": 0.97,
}
BOX = {"total_num_time_steps": 1, "total_num_spatial_boxes": 1, "spatial_overlap": 40}
EIGEN = {
    "eigen_vectors_already_generated": False, "num_eig": 50, "normalize_w_k": 32, "metric": "l2", "knn": 50, "accuracy": 75, "eigen_accuracy": 8,
    "connections": 40,
}
ROI_EXTRACTION = {
    "elbow_threshold_method": True, "elbow_threshold_value": 0.95, "eigen_threshold_method": True, "eigen_threshold_value": 0.9,
    "num_eigen_vector_select": 1, "merge_temporal_coef": 0.99, "roi_size_min": 30, "roi_size_max": 2000, "merge": True, "num_rois": 60,
    "fill_holes": True, "refinement": True, "max_iter": 100, "roi_circ_threshold": 0, "roi_eccentricity_limit": 0.9, "local_max_method": False,
    "area_stop_threshold": 0.95,
}
TIME_TRACE = {"min_neuropil_pixels": 25}
#: Parameters of older documents that have no effect any more.
OLD = {"global": {"num_threads"}, "time_trace": {"time_trace_type", "denoise"}}
#: Least and largest value of a parameter.
RANGES = {
    "median_filter_size": (1, 50), "slice_every": (1, 100), "crop_x": (0, 10_000), "crop_y": (0, 100_000), "trial_length": (25, 10_000),
    "elbow_threshold_value": (0, 1.5), "eigen_threshold_value": (0, 1), "normalize_w_k": (0, 500),
}
#: Stages whose stored results a changed section makes stale.
STALE = {
    "dataset": ("dataset", "box", "eigen"), "filter": ("filter", "box", "eigen"), "box": ("box", "eigen", "roi_extraction"), "eigen": ("eigen",),
    "roi_extraction": ("roi_extraction",),
}
SECTIONS = ("dataset", "filter", "box", "eigen", "roi_extraction", "time_trace")


def as_bool(text: str | bool) -> bool:
    """yes, true, t, y, 1 and no, false, f, n, 0 in either case."""
    if isinstance(text, bool):
        return text
    word = text.strip().lower()
    if word in ("yes", "true", "t", "y", "1"):
        return True
    if word in ("no", "false", "f", "n", "0"):
        return False
    raise ValueError(f"{text!r} is neither true nor false")


@dataclass(frozen=True)
class Config:
    """Sections of a run. accuracy and connections steer the neighbours of tiles of more than EXACT_PIXELS pixels. Parameters of the
    published document that only steer another implementation (loading into memory) are kept and change nothing; unknown ones are refused."""

    global_: dict = field(default_factory=lambda: dict(GLOBAL))
    dataset: dict = field(default_factory=lambda: dict(DATASET))
    filter: dict = field(default_factory=lambda: dict(FILTER))
    box: dict = field(default_factory=lambda: dict(BOX))
    eigen: dict = field(default_factory=lambda: dict(EIGEN))
    roi_extraction: dict = field(default_factory=lambda: dict(ROI_EXTRACTION))
    time_trace: dict = field(default_factory=lambda: dict(TIME_TRACE))
    widefield: bool = False

    @classmethod
    def load(cls, text: str) -> Config:
        """From a JSON document whose sections may end in _params; what it leaves out has its default. A section or parameter that isn't
        known raises KeyError, a value out of range ValueError."""
        out = cls()
        for name, values in json.loads(text).items():
            section = name.removesuffix("_params")
            for key, value in values.items():
                if key not in OLD.get(section, ()):
                    out = out.with_(section, key, value)
        return out

    @classmethod
    def for_widefield(cls) -> Config:
        """The fixed run over one box of masked pixels, merging on any common pixel."""
        return replace(cls(), box=BOX | {"spatial_overlap": 5}, roi_extraction=ROI_EXTRACTION | {"roi_size_max": 600}, widefield=True)

    def with_(self, section: str, key: str, value) -> Config:
        """This configuration with one value changed."""
        name = "global_" if section == "global" else section
        if section not in (*SECTIONS, "global") or key not in getattr(self, name):
            raise KeyError(f"{section}: {key}")
        if key in RANGES:
            low, high = RANGES[key]
            if any(not low <= v <= high for v in (value if isinstance(value, list) else [value])):
                raise ValueError(f"{key} has to be between {low} and {high}, not {value}")
        return replace(self, **{name: getattr(self, name) | {key: value}})

    def dump(self) -> str:
        """The document that load() reads."""
        return json.dumps({f"{k.rstrip('_')}_params": v for k, v in asdict(self).items() if k != "widefield"}, sort_keys=True)

    def key(self, *sections: str) -> str:
        """Digest of some sections, for stored results that depend on them alone."""
        return hashlib.sha256(json.dumps({s: getattr(self, s) for s in sections}, sort_keys=True).encode()).hexdigest()[:16]

    def stage_keys(self) -> dict[str, str]:
        """For each stage the digest of what its stored result depends on."""
        needs = {"filtered": ("dataset", "filter"), "spectra": ("dataset", "filter", "box", "eigen"), "regions": SECTIONS[:5], "traces": SECTIONS}
        return {stage: self.key(*s) for stage, s in needs.items()}

    def stale(self, other: Config) -> set[str]:
        """Sections to compute again when this configuration becomes the other one."""
        return {x for s in STALE if getattr(self, s) != getattr(other, s) for x in STALE[s]}


def task_list(base: Config, values: dict[tuple[str, str], list]) -> list[tuple[int, Config]]:
    """A numbered configuration for each combination of the values given by (section, parameter); the last one changes fastest."""
    out = []
    for k, combination in enumerate(product(*values.values())):
        config = base
        for (section, key), v in zip(values, combination):
            config = config.with_(section, key, v)
        out.append((k, config))
    return out


@dataclass(frozen=True)
class Shape:
    nrows: int
    ncols: int
    nframes: int


def load_stack(dense: DataFrame, config: Config, shape: Shape, mask: DataFrame | None = None) -> tuple[DataFrame, Shape]:
    """Slices, crops, masks and splits; a crop is numbered anew from its corner, and mask(row, col) refers to the uncropped image."""
    d = config.dataset
    nrows, ncols, nframes = shape.nrows, shape.ncols, shape.nframes
    if mask is not None:
        dense = dense.join(F.broadcast(mask.select("row", "col").distinct()), ["row", "col"], "left_semi")  # an image of booleans
    if d["slice_stack"]:
        dense = stack.slice_frames(dense, d["slice_start"], d["slice_every"])
        nframes = -(-(nframes - d["slice_start"]) // d["slice_every"])
    rows, cols = (0, nrows), (0, ncols)
    if d["crop_stack"]:
        rows, cols = (d["crop_x"][0], min(nrows, d["crop_x"][1])), (d["crop_y"][0], min(ncols, d["crop_y"][1]))
    elif d["auto_crop"]:
        rows, cols = stack.auto_crop_range(dense, "row", nrows), stack.auto_crop_range(dense, "col", ncols)
    if rows[0] >= rows[1] or cols[0] >= cols[1]:
        raise ValueError(f"the crop {rows}, {cols} is empty")
    if (rows, cols) != ((0, nrows), (0, ncols)):
        dense, nrows, ncols = stack.cropped(dense, rows, cols), rows[1] - rows[0], cols[1] - cols[0]
    if d["trial_split"]:
        if "trial" in dense.columns:
            raise ValueError("a stack of trials isn't split once more")
        dense = stack.split_trials(dense, d["trial_length"]).withColumnRenamed("block", "trial")
    return dense, Shape(nrows, ncols, nframes)


def preprocess(dense: DataFrame, config: Config, nrows: int, ncols: int, nframes: int, mask: DataFrame | None = None) -> tuple[DataFrame, Shape]:
    """Slice, crop and filter each trial in the fixed order: denoise, z-score or equalisation, median. Also the shape of what is left."""
    dense, shape = load_stack(dense, config, Shape(nrows, ncols, nframes), mask)
    f = config.filter
    keys = [*filters.trial_key(dense), "pixel", "row", "col", "frame"]
    length = config.dataset["trial_length"] if config.dataset["trial_split"] else shape.nframes
    dense = dense.select(*keys, "v")
    if f["localSpatialDenoising"]:
        dense = filters.local_denoise(dense, length).select(*keys, F.col("smooth").alias("v"))
    if f["hist_eq"]:
        dense = filters.equalise(dense, 2.0, shape.nrows, shape.ncols).select(*keys, F.col("eq").alias("v"))
    elif f["z_score"]:
        dense = filters.zscore(dense).select(*keys, F.col("z").alias("v"))
    if f["median_filter"]:
        dense = filters.median3d(dense, shape.nrows, shape.ncols, length, f["median_filter_size"]).select(*keys, F.col("med").alias("v"))
    return dense, shape


#: Pixels of a tile up to which one task makes and solves its graph; larger tiles are solved by many tasks, one tile after the other.
TILE_PIXELS = 1 << 16
#: Pixels of a tile up to which its neighbours are exact; comparing all pixels sends less than a descent does, and takes as long at most.
EXACT_PIXELS = 1 << 20


def large_spectra(tiled: DataFrame, eigen: dict) -> DataFrame:
    """(box, step, pixel, x) of tiles that are too large for one task: neighbours (exact, or by descent with the parameters accuracy and
    connections beyond EXACT_PIXELS), affinities and leading vectors are all relations."""
    tiled, out = graph.cut_lineage(tiled), None
    for box, step in tiled.select("box", "step").distinct().orderBy("box", "step").collect():  # few: a tile has more than TILE_PIXELS pixels
        own = tiled.where((F.col("box") == box) & (F.col("step") == step)).select(F.col("pixel").alias("i"), "x")
        if own.count() <= EXACT_PIXELS:
            near = graph.nearest(own, eigen["knn"], eigen["metric"])
        else:
            near = neighbours.descend(own, eigen["knn"], eigen["metric"], eigen["connections"], eigen["accuracy"])
        near = graph.cut_lineage(near)
        weights = graph.symmetric(graph.affinity(near, min(eigen["normalize_w_k"] + 1, eigen["knn"])))
        found = graph.cut_lineage(spectrum.walk_vectors(graph.cut_lineage(weights.where("w > 0")), eigen["num_eig"], 1e-4))
        part = found.select(F.lit(box).alias("box"), F.lit(step).alias("step"), F.col("i").alias("pixel"), "x")
        out = part if out is None else out.unionByName(part)
    return out


def spectra(filtered: DataFrame, config: Config, shape: Shape) -> DataFrame:
    """(box, pixel, x): leading walk vectors of every tile and time block, blocks one behind the other."""
    per_side = int(config.box["total_num_spatial_boxes"] ** 0.5)
    if per_side**2 != config.box["total_num_spatial_boxes"]:
        raise ValueError("the number of spatial boxes has to be a square")
    overlap = config.box["spatial_overlap"] // 2 if per_side > 1 else 0
    steps = config.box["total_num_time_steps"]
    blocks = stack.time_boxes(filtered, steps).withColumnRenamed("box", "step") if steps > 1 else filtered.withColumn("step", F.lit(0).cast("long"))
    vectors = stack.pixel_vectors(blocks, ("step", "pixel"))
    if config.filter["pca"]:
        if steps > 1:
            raise ValueError("principal components are taken over one time block")
        vectors = graph.principal_vectors(vectors)
    else:
        vectors = vectors.withColumnRenamed("vec", "x")
    place = vectors.withColumns({"row": F.expr(f"pixel div {shape.ncols}"), "col": F.expr(f"pixel % {shape.ncols}")})
    tiled = stack.tile(place, stack.tiles(shape.nrows, shape.ncols, per_side, overlap)).select("box", "step", "pixel", "x")
    e = config.eigen
    if -(-shape.nrows // per_side) * -(-shape.ncols // per_side) > TILE_PIXELS:
        found = large_spectra(tiled, e)
    else:
        found = graph.tile_spectra(tiled, ("box", "step"), e["num_eig"], e["knn"], e["normalize_w_k"], e["metric"])
    return graph.stack_blocks(found, "step", ("box",)) if steps > 1 else found.select("box", "pixel", "x")


def settings(config: Config) -> extract.Settings:
    r = config.roi_extraction
    return extract.Settings(
        r["num_rois"], r["max_iter"], r["roi_size_min"], r["roi_size_max"], r["num_eigen_vector_select"],
        r["eigen_threshold_value"] if r["eigen_threshold_method"] else None, r["elbow_threshold_value"] if r["elbow_threshold_method"] else None,
        r["roi_eccentricity_limit"], r["fill_holes"], r["refinement"], r["area_stop_threshold"] if config.widefield else 1.0, r["local_max_method"] or config.widefield,
    )


def find_regions(dense: DataFrame, config: Config, nrows: int, ncols: int, nframes: int, mask: DataFrame | None = None, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """(roi, pixel, row, col) in the loaded (cropped) image: spectrum and clustering per tile, merging across tiles by overlap and
    correlation, filling, and the limit of circularity. Trials follow each other in time.

    keep(stage, make) gives the stages filtered, spectra and regions: what make() makes, or what was stored of it.
    """
    keep = keep or (lambda stage, make: graph.cut_lineage(make()))
    _, shape = load_stack(dense, config, Shape(nrows, ncols, nframes), mask)

    def filter_() -> DataFrame:
        filtered, _ = preprocess(dense, config, nrows, ncols, nframes, mask)
        return stack.join_trials(filtered) if "trial" in filtered.columns else filtered

    filtered = keep("filtered", filter_)
    vectors = keep("spectra", lambda: spectra(filtered, config, shape))
    return keep("regions", lambda: _clustered(dense, filtered, vectors, config, shape, Shape(nrows, ncols, nframes), mask))


def _clustered(dense: DataFrame, filtered: DataFrame, vectors: DataFrame, config: Config, shape: Shape, whole: Shape, mask: DataFrame | None) -> DataFrame:
    """The regions of spectra, merged and filled."""
    evec = vectors.selectExpr("box", f"pixel div {shape.ncols} as row", f"pixel % {shape.ncols} as col", "x")
    found = extract.spectral_regions(evec, settings(config)).selectExpr("box * 1000000 + roi as roi", f"row * {shape.ncols} + col as pixel", "row", "col")
    found = graph.cut_lineage(found)
    r = config.roi_extraction
    if r["merge"]:
        loaded, _ = load_stack(dense, config, whole, mask)
        loaded = stack.join_trials(loaded) if "trial" in loaded.columns else loaded
        pairs = regions.merge_pairs(found, traces.mean_trace(found, loaded), None if config.widefield else 0.1, r["merge_temporal_coef"])
        found = regions.merge(found, pairs)
        if r["fill_holes"]:
            inside = filtered.select("pixel").distinct()
            found = regions.fill_holes(found).selectExpr("roi", f"row * {shape.ncols} + col as pixel", "row", "col").join(inside, "pixel", "left_semi")
    if config.widefield:
        found = regions.resolve_in_spectrum(found, vectors.where("box = 0"))
    if r["roi_circ_threshold"] > 0:
        found = found.join(edges.circle_fit(found).where(F.col("circularity") >= r["roi_circ_threshold"]).select("roi"), "roi", "left_semi")
    return found.select("roi", "pixel", "row", "col")


def region_traces(found: DataFrame, frames: DataFrame, config: Config, shape: Shape) -> DataFrame:
    """(roi, kind, frame, v): all kinds of traces, with surrounds of the size that the configuration asks for."""
    around = regions.sized_ring(found, shape.nrows, shape.ncols, config.time_trace["min_neuropil_pixels"])
    return traces.all_kinds(found, around, frames)


def add_region(all_: DataFrame, pixels: DataFrame) -> DataFrame:
    """One more region, numbered one above the largest (1 in an empty set)."""
    number = all_.agg((F.coalesce(F.max("roi"), F.lit(0)) + 1).cast("long").alias("roi"))
    return all_.unionByName(pixels.select("pixel", "row", "col").distinct().join(F.broadcast(number)).select("roi", "pixel", "row", "col"))


def delete_region(all_: DataFrame, roi: int, *dependent: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
    """Without a region; traces and class links given behind it lose theirs as well."""
    kept = tuple(df.where(F.col("roi") != roi) for df in (all_, *dependent))
    return kept if dependent else kept[0]


def add_pixels(all_: DataFrame, roi: int, pixels: DataFrame) -> DataFrame:
    """Region with more pixels(pixel, row, col)."""
    return all_.unionByName(pixels.select(F.lit(roi).cast("long").alias("roi"), "pixel", "row", "col")).distinct()


def subtract_pixels(all_: DataFrame, roi: int, pixels: DataFrame) -> DataFrame:
    gone = pixels.select(F.lit(roi).cast("long").alias("roi"), "pixel").distinct()
    return all_.join(gone, ["roi", "pixel"], "left_anti").select("roi", "pixel", "row", "col")


def combine(all_: DataFrame, rois: list[int]) -> DataFrame:
    """Chosen regions as one, under a new number, one above the largest."""
    number = all_.agg((F.max("roi") + 1).cast("long").alias("number"))
    one = F.when(F.col("roi").isin(rois), F.col("number")).otherwise(F.col("roi"))
    return all_.join(F.broadcast(number)).withColumn("roi", one).select("roi", "pixel", "row", "col").distinct()
