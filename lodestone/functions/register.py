"""The scalar functions under their names in SQL, for the session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.relational import TOKEN_BREAKS, TOKEN_MARKS

_PIXEL = "cast(floor(greatest(0D, least(({share}) * shiftleft(256L, zoom) + 0.5D, cast(shiftleft(256L, zoom) - 1 as double)))) as bigint)"
_SINE = "sin(greatest(-89.9D, least(lat, 89.9D)) * pi() / 180)"
_X = _PIXEL.format(share="(lng + 180) / 360")
_Y = _PIXEL.format(share=f"0.5D - ln((1 + {_SINE}) / (1 - {_SINE})) / (4 * pi())")

SQL_FUNCTIONS = {
    "square(x DOUBLE) RETURNS DOUBLE": "x * x",
    "tokens(line STRING) RETURNS ARRAY<STRING>": f"filter(split(line, '{TOKEN_BREAKS}'), t -> t <> '')",
    "clean_token(token STRING) RETURNS STRING": f"regexp_replace(lower(token), '{TOKEN_MARKS}', '')",
    "quadkey(lng DOUBLE, lat DOUBLE, zoom INT) RETURNS STRING": f"lpad(cast(cast(bin(shiftright({_X}, 8)) as decimal(23,0)) + 2 * cast(bin(shiftright({_Y}, 8)) as decimal(23,0)) as string), zoom, '0')",
    "haversine(lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": "2 * asin(least(1D, sqrt(power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lng2) - radians(lng1)) / 2), 2))))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary functions of the session; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    from lodestone.operators.chaos import henon, largest_exponent

    @F.pandas_udf("double")
    def lyapunov_henon(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(largest_exponent(henon(a.to_numpy(float), b.to_numpy(float)), np.zeros((2, len(a)))))

    spark.udf.register("lyapunov_henon", lyapunov_henon)
    return [head.split("(")[0] for head in SQL_FUNCTIONS] + ["lyapunov_henon"]
