"""Named configurations of published training recipes."""

from __future__ import annotations

# Detector, sampler and schedule of each recipe.
PRESETS = {
    "midnight": {
        "detector": ("hsv", {"hue": (90, 180), "sat": (8, 255), "val": (103, 255)}),
        "sampler": ("multi", {"targets": (0.25, 0.5, 1.0, 2.0), "patch_size": 256, "threshold": 0.4}), "filter": 0.6, "hed": 0.05,
        "order": "random", "pool": 8, "per_slide": 100, "cycle": True,
    },
    "uni": {
        "detector": ("clam", {}), "sampler": ("random", {"patch_size": 256, "target_mpp": 0.5}), "pool": 8, "per_slide": 100, "cycle": True,
    },
    "virchow2": {
        "detector": ("hsv", {"hue": (90, 180), "sat": (8, 255), "val": (103, 255)}),
        "sampler": ("random", {"patch_size": 392, "target_mpp": 0.5, "threshold": 0.65}), "order": "random",
    },
    "gpfm": {"detector": ("clam", {"use_otsu": True, "a_t": 16, "a_h": 4}), "sampler": ("random", {"patch_size": 512, "level": 0})},
    "prov-gigapath": {"detector": ("otsu", {}), "sampler": ("random", {"patch_size": 256, "target_mpp": 0.5, "threshold": 0.1})},
    "phikon": {"detector": ("otsu", {}), "sampler": ("random", {"patch_size": 224, "target_mpp": 0.5, "threshold": 0.6})},
}
# Global and local crops of the multi-crop views.
MULTI_CROP = {
    "midnight": [("global", 224, (0.32, 1.0), 2), ("local", 98, (0.05, 0.32), 8)],
    "uni": [("global", 224, (0.32, 1.0), 2), ("local", 96, (0.05, 0.32), 8)],
    "gpfm": [("global", 224, (0.32, 1.0), 2), ("local", 98, (0.05, 0.32), 8)],
    "prov-gigapath": [("global", 224, (0.32, 1.0), 2), ("local", 98, (0.05, 0.32), 8)],
    "phikon": [("global", 224, (0.32, 1.0), 2), ("local", 96, (0.05, 0.32), 8)],
}


def detector(name: str):
    from ..operators import images

    kind, options = PRESETS[name]["detector"]
    return {"hsv": images.HsvTissue, "clam": images.ClamTissue, "otsu": images.OtsuTissue}[kind](**options)


def views(name: str) -> list:
    from ..operators.images import RandomCrop
    from ..operators.views import View

    return [View(n, crop=RandomCrop(size, scale), count=count) for n, size, scale, count in MULTI_CROP[name]]


def pipeline(name: str, slides, make, *, per_slide: int | None = None, seed: int = 0, epochs: int = 1, multi_crop: bool = False, thumbnail: int = 2048):
    """The recipe as a pipeline over a table of slides, read by ``make``; with ``multi_crop`` it yields the recipe's views.

    ``per_slide`` patches of each slide and epoch, where the recipe names no number 100.  Recipes that cycle do so in
    :meth:`.pipeline.Pipeline.batches`.
    """
    from ..operators import images
    from .pipeline import Pipeline

    recipe = PRESETS[name]
    kind, options = recipe["sampler"]
    n = per_slide or recipe.get("per_slide", 100)
    p = Pipeline(slides, seed=seed, epochs=epochs).tissue(detector(name), make, thumbnail)
    p = getattr(p, kind)(n, **options).schedule(recipe.get("pool", 8), n, order=recipe.get("order", "sequential")).read(make)
    if "filter" in recipe:
        p = p.filter(images.HsvFilter(min_fraction=recipe["filter"]))
    jitter = [images.HedJitter(recipe["hed"])] if "hed" in recipe else []
    if multi_crop:
        return p.views(*views(name), shared=jitter)
    return p.transform(*jitter) if jitter else p
