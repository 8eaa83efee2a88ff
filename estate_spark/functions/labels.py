"""Readable descriptions of a feature and its value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estate_spark.functions.text import fixed

# fixed values
BOOLEAN = {
    "has_terrace": ("having a terrace", "not having a terrace"),
    "has_lift": ("having a lift", "not having a lift"),
    "has_air_conditioning": ("having air conditioning", "not having air conditioning"),
    "has_parking": ("having a parking space", "not having a parking space"),
    "parking_included_in_price": ("parking included in the price", "parking not included in the price"),
    "has_north_orientation": ("north orientation", "no north orientation"),
    "has_south_orientation": ("south orientation", "no south orientation"),
    "has_east_orientation": ("east orientation", "no east orientation"),
    "has_west_orientation": ("west orientation", "no west orientation"),
    "has_box_room": ("having a box room", "not having a box room"),
    "has_wardrobe": ("having fitted wardrobes", "not having fitted wardrobes"),
    "has_swimming_pool": ("having a swimming pool", "not having a swimming pool"),
    "has_doorman": ("having a doorman", "not having a doorman"),
    "has_garden": ("having a garden", "not having a garden"),
    "is_duplex": ("being a duplex", "not being a duplex"),
    "is_studio": ("being a studio", "not being a studio"),
    "is_top_floor": ("being on the top floor", "not being on the top floor"),
}
# feature -> (stem, decimals, grouped by thousands, unit)
CONTINUOUS = {
    "area_m2": ("size", 0, False, " m2"),
    "rooms": ("number of rooms", 0, False, ""),
    "bathrooms": ("number of bathrooms", 0, False, ""),
    "floor": ("floor level", 0, False, ""),
    "construction_year": ("construction year", 0, False, ""),
    "property_age": ("property age", 0, False, " years"),
    "latitude": ("latitude", 4, False, ""),
    "longitude": ("longitude", 4, False, ""),
    "parking_space_price": ("parking space price", 0, True, " euros"),
    "amenity_id": ("amenity category", 0, False, ""),
    "flat_location_id": ("interior/exterior location code", 0, False, ""),
    "cad_construction_year": ("cadastral construction year", 0, False, ""),
    "cad_max_building_floor": ("building max floor", 0, False, ""),
    "cad_dwelling_count": ("number of dwellings in the building", 0, False, ""),
    "cadastral_quality_id": ("cadastral quality band", 0, False, ""),
    "distance_to_city_center": ("distance to the city center", 1, False, " km"),
    "distance_to_metro": ("distance to the nearest metro", 1, False, " km"),
    "distance_to_castellana": ("distance to Paseo de la Castellana", 1, False, " km"),
}
CATEGORY = {"property_type": "property type", "condition": "condition", "neighborhood_id": "neighborhood"}


def describe(feature: str, value: Column, zone_name: Column | None = None) -> Column:
    if feature in BOOLEAN:
        present, absent = BOOLEAN[feature]
        return F.when(value.try_cast("double") == 1.0, present).otherwise(absent)
    if feature in CATEGORY:
        text = F.coalesce(value.cast("string"), F.lit("None"))
        if feature == "neighborhood_id" and zone_name is not None:
            text = F.when(F.length(zone_name) > 0, zone_name).otherwise(text)
        return F.concat(F.lit(CATEGORY[feature] + " ("), text, F.lit(")"))
    if feature in CONTINUOUS:
        stem, digits, grouped, unit = CONTINUOUS[feature]
        v = value.try_cast("double")
        number = F.format_number(v, digits) if grouped else fixed(v, digits)
        return F.when(v.isNotNull(), F.concat(F.lit(stem + " ("), number, F.lit(unit + ")"))).otherwise(stem)
    return F.lit(feature.replace("_", " "))
