"""Layer descriptions, published examples, and round trips."""

import pytest
from pyspark.sql import functions as F

from diurnal.catalog.geometry import LAYERS
from diurnal.functions import crs
from diurnal.functions.shapes import CONUS_ALBERS, albers

CLARKE = 'SPHEROID["Clarke 1866",6378206.4,294.9786982]'


def at(spark, p):
    r = spark.range(1).select(p.alias("p")).first()["p"]
    return r["x"], r["y"]


def projected(name, **parameters):
    given = ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters.items())
    return crs.read_crs(f'PROJCS["x",GEOGCS["g",DATUM["d",{CLARKE}],UNIT["Degree",0.0174532925199433]],PROJECTION["{name}"],{given},UNIT["Meter",1.0]]')


def test_published_examples(spark):
    """Snyder (1987), pp. 292, 296, 267: ellipsoid of 1866, 35 N 75 W."""
    conic = {"Standard_Parallel_1": 29.5, "Standard_Parallel_2": 45.5, "Latitude_Of_Origin": 23.0, "Central_Meridian": -96.0}
    a = projected("Albers", **conic)
    assert at(spark, a.forward(F.lit(-75.0), F.lit(35.0))) == pytest.approx((1885472.7, 1535925.0), abs=0.5)
    conic |= {"Standard_Parallel_1": 33.0, "Standard_Parallel_2": 45.0}
    l = projected("Lambert_Conformal_Conic_2SP", **conic)
    assert at(spark, l.forward(F.lit(-75.0), F.lit(35.0))) == pytest.approx((1894410.9, 1564649.5), abs=0.5)
    m = projected("Mercator", Central_Meridian=-180.0)
    assert at(spark, m.forward(F.lit(-75.0), F.lit(35.0))) == pytest.approx((11688673.7, 4139145.6), abs=0.5)


@pytest.mark.parametrize("layer", LAYERS)
def test_round_trips(spark, layer):
    system = crs.read_crs(LAYERS[layer])
    df = spark.range(500).selectExpr("-124.7 + id % 25 * 2.31 as lon", "24.1 + int(id / 25) * 1.27 as lat")
    p = df.withColumn("p", system.forward("lon", "lat")).withColumn("b", system.inverse("p.x", "p.y"))
    far = p.agg(F.max(F.abs(F.col("b.x") - F.col("lon"))), F.max(F.abs(F.col("b.y") - F.col("lat")))).first()
    assert max(far) < 1e-9
    assert at(spark, system.forward(F.lit(None).cast("double"), F.lit(1.0)))[0] is None


def test_southern_cone_and_single_parallel(spark):
    for s in (
        crs.Crs("albers", e2=0.0067, lat1=-18.0, lat2=-36.0, lat0=0.0, lon0=132.0),
        crs.Crs("lambert", e2=0.0067, lat1=-18.0, lat2=-36.0, lat0=-20.0, lon0=134.0),
        crs.Crs("lambert", lat1=40.0, lat2=40.0, lat0=40.0, scale=0.9996, lon0=120.0),
        crs.Crs("mercator", e2=0.0067, lat1=30.0, lon0=110.0),
    ):
        sign = -1 if s.lat1 < 0 else 1
        p = s.forward(F.lit(140.0), F.lit(sign * 33.0))
        back = spark.range(1).select(p.alias("p")).select(s.inverse("p.x", "p.y").alias("p")).first()["p"]
        assert (back["x"], back["y"]) == pytest.approx((140.0, sign * 33.0), abs=1e-9)


def test_a_layer_s_file_decides(spark, tmp_path):
    (tmp_path / "tracts.prj").write_text(LAYERS["albers"])
    system = crs.layer_crs(spark, str(tmp_path / "tracts.prj"))
    want = at(spark, albers(F.lit(-87.6), F.lit(41.9), **CONUS_ALBERS))
    assert at(spark, system.forward(F.lit(-87.6), F.lit(41.9))) == pytest.approx(want)


def test_unknown_descriptions_are_errors():
    with pytest.raises(ValueError, match="projection"):
        projected("Hotine_Oblique_Mercator", Azimuth=3.0)
    with pytest.raises(ValueError, match="parameter"):
        projected("Albers", Azimuth=3.0)
    with pytest.raises(ValueError, match="spheroid"):
        crs.read_crs('GEOGCS["g"]')
