"""Raster operators: selection, padding, clipping, warping, mosaics, gap filling, map algebra."""

from gridloom.operators.algebra import align, bands_as_columns, band_stats, reduce_dim, stack_columns, zonal
from gridloom.operators.clip import clip
from gridloom.operators.gapfill import interpolate_na
from gridloom.operators.mosaic import merge_arrays, merge_datasets
from gridloom.operators.select import clip_box, isel, isel_window, sel_nearest, slice_xy
from gridloom.operators.pad import pad_box, pad_xy
from gridloom.operators.warp import default_grid, reproject, reproject_match

DATASET_OPERATIONS = {"clip_box": clip_box, "clip": clip, "pad_box": pad_box, "reproject": reproject, "reproject_match": reproject_match, "interpolate_na": interpolate_na}

__all__ = [
    "DATASET_OPERATIONS", "align", "band_stats", "bands_as_columns", "clip", "clip_box", "default_grid", "interpolate_na", "isel", "isel_window",
    "merge_arrays", "merge_datasets", "pad_box", "pad_xy", "reduce_dim", "reproject", "reproject_match", "sel_nearest", "slice_xy", "stack_columns", "zonal",
]
