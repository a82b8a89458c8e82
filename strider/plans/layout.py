"""Queries without a plain SQL form: model slots, alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import kinematics as kin
from ..operators import models
from . import views
from .catalog import query


@query()
def lifted_poses(spark, sf_dir):
    """A stub lifting model in the flip ensemble."""

    def load():
        order = np.arange(51).reshape(17, 3)
        order[list(kin.LEFT + kin.RIGHT)] = order[list(kin.RIGHT + kin.LEFT)]
        sign = np.tile([-1.0, 1.0, 1.0], 17)
        flip = lambda x: x[:, order.reshape(-1)] * sign
        return models.flip_ensemble(lambda x: x * 0.5 + 0.1, flip)

    return models.predict(views.poses(spark, sf_dir), load, "pose", "lifted").select("clip", "frame", "lifted")


@query()
def aligned_error(spark, sf_dir):
    """Error of each pose against the clip's first after the best alignment."""
    p = views.poses(spark, sf_dir)
    first = p.where("frame = 0").select("clip", F.col("pose").alias("target"))
    return models.aligned_error(p.withColumnRenamed("pose", "source").join(first, "clip")).select("clip", "frame", "error")
