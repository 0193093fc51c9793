"""Pictures as PNG files: tissue masks, sampled places, filters, stain jitter, transforms, views and magnifications."""

import numpy as np
from pyspark.sql import functions as F

from common import arguments, open_slides
from patchloom import viz
from patchloom.operators import images, sampling
from patchloom.operators.views import View
from patchloom.plans import presets
from patchloom.plans.pipeline import Pipeline

args = arguments(out="figures", size=256)
spark, slides, make = open_slides(args, 2)
slide = slides.orderBy("path").first()
reader = make()
reader.open(slide.path)
scale = args.size / max(slide.width, slide.height)
thumb = reader.thumbnail(max(1, int(slide.width * scale)), max(1, int(slide.height * scale)))
one = slides.filter(F.col("path") == slide.path)
pair = (slide.width / thumb.shape[1], slide.height / thumb.shape[0])


def save(name: str, picture: np.ndarray) -> None:
    viz.save_png(picture, f"{args.out}/{name}.png")
    print(name, picture.shape)


detectors = {"otsu": images.OtsuTissue(), "hsv": images.HsvTissue(), "clam": images.ClamTissue(a_t=1, a_h=1)}
for name, d in detectors.items():
    save(f"tissue_{name}", viz.overlay(thumb, d.detect(thumb, pair)))

base = Pipeline(one, seed=3).tissue(images.HsvTissue(), make, size=args.size).read(make)
samplers = {
    "grid": base.grid(512), "random": base.random(40), "multi": base.multi(40), "continuous": base.continuous(40),
    "pool": base.random(40, replacement=False),
}
for name, p in samplers.items():
    save(f"places_{name}", viz.markers(thumb, [(r.x, r.y) for r in p.coordinates().select("x", "y").collect()], (slide.width, slide.height)))


def pictures(p, of=lambda r: r.image) -> list[np.ndarray]:
    made = [of(r) for r in p.patches().orderBy("draw").collect()]
    return [np.frombuffer(m["data"], m["dtype"]).reshape(m["height"], m["width"], -1) for m in made]


few = base.random(8)
save("patches", viz.patch_grid(pictures(few), 4))
save("patches_filtered", viz.patch_grid(pictures(few.filter(images.HsvFilter())), 4))
patch = pictures(few)[0]
save("stain_jitter", viz.compare(patch, {f"jitter {s}": images.HedJitter(s) for s in (0.02, 0.05, 0.1, 0.2)}))
save("transforms", viz.compare(patch, {"flip": images.FlipRotate(1, 1, 1), "crop": images.RandomCrop(128), "resize": images.Resize(64)}))
views = few.views(View("global", crop=images.RandomCrop(224, (0.32, 1.0)), count=2), View("local", crop=images.RandomCrop(98, (0.05, 0.32)), count=4), View("wide", mpp=1.0))
names = ["global_0", "global_1", *[f"local_{i}" for i in range(4)], "wide"]
save("views", viz.patch_grid([a for n in names for a in pictures(views, lambda r: r.views[n])[:1]], len(names)))

# Drawn magnifications as bars, uniform and by the two weightings.
bars = []
for name, cdf in (("uniform", None), ("maxavg", sampling.maxavg_weights(spark)), ("minmax", sampling.minmax_weights(spark))):
    c = base.continuous(300, cdf=cdf.select("x", "cdf") if cdf is not None else None).coordinates()
    counts = {int(r.b): r["count"] for r in c.groupBy(F.floor((F.col("mpp") - 0.25) / 0.0875).alias("b")).count().collect()}
    picture = np.full((100, 160, 3), 255, np.uint8)
    for b in range(20):
        height = int(90 * counts.get(b, 0) / max(counts.values()))
        picture[100 - height :, b * 8 + 1 : b * 8 + 7] = (120, 60, 160)
    bars.append(picture)
save("magnifications", np.concatenate(bars, 1))
for name in presets.PRESETS:
    p = presets.pipeline(name, one, make, per_slide=8, thumbnail=args.size)
    save(f"recipe_{name}", viz.patch_grid(pictures(p)[:8] or [np.full((8, 8, 3), 255, np.uint8)], 8))
reader.close()
