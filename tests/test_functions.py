"""Column expressions on the cases that change answers."""

import math

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import dates as D
from fieldtally.functions import names as N
from fieldtally.functions import values as V
from fieldtally.functions.geo import haversine_m, mercator_to_lat, mercator_to_lon


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "name, genus, epithet, infra, short",
    [
        ("Acer rubrum", "Acer", "rubrum", None, "Acer"),
        ("Esox americanus americanus", "Esox", "americanus", "americanus", "Esox americanus"),
        # the hybrid mark is no letter, so the removed "word" behind the first blank is empty
        ("Quercus × bebbiana", "Quercus", None, "bebbiana", "Quercus× bebbiana"),
        ("Éupatorium perfoliatum", "Éupatorium", "perfoliatum", None, "Éupatorium"),
        ("Acer", "Acer", None, None, "Acer"),
        ("", "", None, None, ""),
        ("Larus sp. (gull)", "Larus", "sp.", None, "Larus. (gull)"),
    ],
)
def test_name_parts(spark, name, genus, epithet, infra, short):
    text = F.lit(name)
    assert one(spark, N.genus(text)) == genus
    assert one(spark, N.epithet(text)) == epithet
    assert one(spark, N.infraspecific(text)) == infra
    assert one(spark, N.drop_first_word(text)) == short


def test_missing_name_stays_missing(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, N.genus(nothing)) is None
    assert one(spark, N.epithet(nothing)) is None
    assert one(spark, N.drop_first_word(nothing)) is None


def test_genus_entries(spark):
    assert one(spark, N.genus_of_list_entry(F.lit("Lonicera spp."))) == "Lonicera"
    assert one(spark, N.is_genus_entry(F.lit("Lonicera spp."))) is True
    # the full stop is a wildcard: any character may stand at the end
    assert one(spark, N.is_genus_entry(F.lit("Lonicera sppx"))) is True
    assert one(spark, N.is_genus_entry(F.lit("Lonicera spp"))) is False
    assert one(spark, N.is_genus_entry(F.lit(None).cast("string"))) is False


def test_labels_and_recodes(spark):
    assert one(spark, N.strip_bracketed(F.lit("Laridae (Gulls, Terns)"))) == "Laridae"
    assert one(spark, N.tidy_status(F.lit("Endangered"), "federally")) == "federally endangered"
    assert one(spark, N.recode(F.lit("Boloria selene"), N.SPECIES_SYNONYMS)) == "Boloria myrina"
    assert one(spark, N.recode(F.lit("Boloria other"), N.SPECIES_SYNONYMS)) == "Boloria other"
    assert one(spark, N.kingdom_of_group(F.lit("Aves"))) == "Animalia"
    assert one(spark, N.kingdom_of_group(F.lit("Plantae"))) == "Plantae"
    assert one(spark, N.kingdom_of_group(F.lit(""))) == ""
    assert one(spark, N.binomial(F.lit("Acer"), F.lit(None).cast("string"))) == "Acer"


def test_counts_held_as_text(spark):
    values = [one(spark, V.count_from_text(F.lit(t))) for t in ("X", "3", "", "many")]
    assert values == [1.0, 3.0, None, None]


def test_ratios_and_rounding(spark):
    assert one(spark, V.ratio(F.lit(1), F.lit(0))) is None
    # half to even, not half up
    assert one(spark, V.percent(F.lit(1), F.lit(800), 2)) == 0.12
    assert one(spark, V.percent(F.lit(3), F.lit(800), 2)) == 0.38
    assert one(spark, V.zero_if_null(F.lit(None).cast("int"))) == 0
    assert one(spark, V.null_if_zero(F.lit(0))) is None
    assert one(spark, V.message("%s checklists", F.lit(7))) == "7 checklists"
    assert [one(spark, V.is_filled(F.lit(t).cast("string"))) for t in ("a", "", None)] == [True, False, False]


def test_dates(spark):
    assert str(one(spark, D.date_from_text(F.lit("2023-07-04")))) == "2023-07-04"
    assert one(spark, D.date_from_text(F.lit(""))) is None
    assert one(spark, D.date_from_text(F.lit("soon"))) is None
    assert str(one(spark, D.month_start(F.lit("2023-07-04").cast("date")))) == "2023-07-01"
    assert str(one(spark, D.month_from_parts(F.lit(2023), F.lit(2)))) == "2023-02-01"
    months = one(spark, D.month_sequence(F.lit("2022-11-15").cast("date"), F.lit("2023-02-01").cast("date")))
    assert [str(m) for m in months] == ["2022-11-01", "2022-12-01", "2023-01-01", "2023-02-01"]


def test_sphere_and_projection(spark):
    metres = one(spark, haversine_m(F.lit(-68.66641), F.lit(44.43629), F.lit(-68.65944), F.lit(44.43629)))
    by_hand = 2 * 6378137 * math.asin(math.cos(math.radians(44.43629)) * math.sin(math.radians(0.00697) / 2))
    assert metres == pytest.approx(by_hand, abs=1e-6)
    x = 6378137 * math.radians(-68.2)
    y = 6378137 * math.log(math.tan(math.pi / 4 + math.radians(44.3) / 2))
    assert one(spark, mercator_to_lon(F.lit(x))) == pytest.approx(-68.2, abs=1e-9)
    assert one(spark, mercator_to_lat(F.lit(y))) == pytest.approx(44.3, abs=1e-9)
