"""A training loop: endless batches of stained patches for one rank, with metrics of waiting and working.

RANK and WORLD_SIZE, if set, choose the slides; each rank runs this script in a session of its own.
"""

import numpy as np

from common import arguments, open_slides
from patchloom.operators import geometry, images
from patchloom.plans.monitor import MonitoredLoader
from patchloom.plans.pipeline import Pipeline

args = arguments(steps=6, batch=16)
spark, slides, make = open_slides(args)
own = geometry.rank_partition(slides, "path")
p = Pipeline(own, seed=1).tissue(images.HsvTissue(), make, size=256).random(8, target_mpp=0.5).schedule(pool=4, per_slide=8).read(make)
p = p.filter(images.HsvFilter(min_fraction=0.2)).transform(images.FlipRotate(), images.HedJitter()).metadata()

batches = p.batches(args.batch, "uint8", cycle=True)
weights = np.zeros(3)
for step, batch in enumerate(MonitoredLoader(batches, every=3, metrics=print), 1):
    # Where a model would be: the mean colour of all patches so far.
    weights += (batch["image"].mean((0, 2, 3)) - weights) / step
    if step == args.steps:
        break
batches.close()
print("mean colour", weights.round(1), "of", step, "batches, epochs up to", max(batch["epoch"]))
