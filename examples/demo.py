"""Slides without files: masks, a random sample, a table of statistics and a few batches."""

from patchloom.operators import images
from patchloom.plans.monitor import MonitoredLoader
from patchloom.plans.pipeline import Pipeline
from patchloom.session import session
from patchloom.sources.readers import Synthetic
from patchloom.sources.slides import properties

spark = session(4)
paths = spark.createDataFrame([(f"memory://slide_{i}.svs",) for i in range(6)], "path string")
slides = properties(paths, Synthetic).drop("error")
p = Pipeline(slides, seed=7).tissue(
    images.OtsuTissue(), Synthetic, size=256,
).random(10, target_mpp=0.5).schedule(pool=3, per_slide=10).read(Synthetic).transform(images.FlipRotate(), images.HedJitter())
p.stats().orderBy("key").show(50, truncate=False)
for batch in MonitoredLoader(p.batches(16), every=2, metrics=print):
    print(batch["image"].shape)
