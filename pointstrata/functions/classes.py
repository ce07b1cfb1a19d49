"""Class dictionaries.  All tables here are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: report names
REPORT_NAMES = {
    1: "Nieklasyfikowane", 2: "Grunt", 3: "Roslinnosc_niska", 4: "Roslinnosc_srednia", 5: "Roslinnosc_wysoka",
    6: "Budynek", 7: "Szum", 9: "Woda", 17: "Most", 18: "Tory_kolejowe", 19: "Linie_energetyczne",
    20: "Slupy_trakcyjne", 21: "Peron", 30: "Jezdnia", 32: "Kraweznik", 35: "Znak_drogowy", 36: "Bariera",
    40: "Sciana", 41: "Dach",
}

# fixed values: viewer colours
VIEWER_COLOURS = {
    1: "#9E9E9E", 2: "#8D6E63", 3: "#AED581", 4: "#66BB6A", 5: "#2E7D32", 6: "#D7CCC8", 7: "#F44336", 9: "#29B6F6",
    17: "#795548", 18: "#6D4C41", 19: "#FDD835", 20: "#546E7A", 21: "#78909C", 30: "#455A64", 32: "#B0BEC5",
    35: "#FF5722", 36: "#90A4AE", 40: "#BCAAA4", 41: "#A1887F",
}

# fixed values: full dictionary of the extended report (name, description)
EXTENDED = {
    1: ("Nieklasyfikowane", "Punkty bez przypisanej klasy"), 2: ("Grunt", "Powierzchnia gruntu"),
    3: ("Roslinnosc niska", "Trawy <0.5m"), 4: ("Roslinnosc srednia", "Krzewy 0.5-2m"),
    5: ("Roslinnosc wysoka", "Drzewa >2m"), 6: ("Budynek", "Obiekty kubaturowe"),
    7: ("Szum", "Punkty bledne/zaklocenia"), 9: ("Woda", "Zbiorniki wodne"), 17: ("Most", "Obiekty mostowe"),
    18: ("Tory kolejowe", "Szyny i podklady"), 19: ("Linie energetyczne", "Przewody nad torami"),
    20: ("Slupy trakcyjne", "Maszty i wsporniki"), 21: ("Peron kolejowy", "Krawedz peronowa"),
    22: ("Znaki kolejowe", "Semafory i tablice"), 23: ("Ogrodzenie kolejowe", "Siatki wzdluz linii"),
    30: ("Jezdnia", "Nawierzchnia drogowa"), 31: ("Chodnik", "Nawierzchnia piesza"),
    32: ("Kraweznik", "Granica jezdnia/chodnik"), 33: ("Pas zieleni", "Zielen przydrozna"),
    34: ("Oswietlenie", "Latarnie"), 35: ("Znak drogowy", "Slupki i tablice"), 36: ("Bariera drogowa", "Barierki ochronne"),
    40: ("Sciany budynkow", "Fasady zewnetrzne"), 41: ("Dachy budynkow", "Pokrycie dachowe"),
    64: ("Terminal lotniska", "Budynki lotniskowe"), 65: ("Pas startowy", "Nawierzchnia lotniskowa"),
    66: ("Wezzel kolejowy", "Skrzyzowania torow"), 67: ("Parking", "Miejsca postojowe"),
}

# fixed values: element type, predefined type and label per class in building models
IFC_TYPES = {
    1: ("IfcBuildingElementProxy", "USERDEFINED", "Unclassified"), 2: ("IfcSite", "ELEMENT", "Ground"),
    3: ("IfcGeographicElement", "USERDEFINED", "Low Vegetation"),
    4: ("IfcGeographicElement", "USERDEFINED", "Medium Vegetation"),
    5: ("IfcGeographicElement", "USERDEFINED", "High Vegetation"), 6: ("IfcBuilding", "ELEMENT", "Building"),
    7: ("IfcBuildingElementProxy", "USERDEFINED", "Noise"), 9: ("IfcGeographicElement", "TERRAIN", "Water"),
    18: ("IfcRailway", "USERDEFINED", "Railway Track"), 19: ("IfcCableCarrierSegment", "CABLESEGMENT", "Power Line"),
    20: ("IfcColumn", "COLUMN", "Traction Pole"), 21: ("IfcSlab", "FLOOR", "Railway Platform"),
    30: ("IfcPavement", "USERDEFINED", "Road Surface"), 32: ("IfcCurbOrKerb", "USERDEFINED", "Curb"),
    35: ("IfcSign", "USERDEFINED", "Road Sign"), 36: ("IfcRailing", "GUARDRAIL", "Road Barrier"),
    40: ("IfcWall", "SOLIDWALL", "Building Wall"), 41: ("IfcRoof", "FLAT_ROOF", "Building Roof"),
}

# fixed values: element type per object kind
ELEMENT_TYPES = {
    "building": "IfcBuilding", "terrain": "IfcSite", "pole": "IfcColumn", "wire": "IfcCableSegment", "track": "IfcRail",
    "signal": "IfcSignal", "vegetation": "IfcGeographicElement", "road": "IfcRoad", "bridge": "IfcBridge",
}

# fixed values: clash element names
CLASH_NAMES = {
    2: "ground", 3: "low_vegetation", 4: "medium_vegetation", 5: "high_vegetation", 6: "building", 7: "noise",
    18: "railway", 19: "wire", 20: "pole",
}

# fixed values: names in model comparison
MODEL_NAMES = {2: "Grunt", 3: "Rosl. niska", 4: "Rosl. srednia", 5: "Rosl. wysoka", 6: "Budynek", 7: "Szum",
               18: "Tory", 19: "Linie", 20: "Slupy"}


def name_of(table: dict, key: Column, default: Column) -> Column:
    """Lookup in a small fixed dictionary as a map literal."""
    items = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*items), key), default)


def class_dim(spark: SparkSession) -> DataFrame:
    """scheme, class_id, name, colour, description."""
    rows = [("report", k, v, VIEWER_COLOURS.get(k), None) for k, v in REPORT_NAMES.items()]
    rows += [("extended", k, n, VIEWER_COLOURS.get(k), d) for k, (n, d) in EXTENDED.items()]
    rows += [("ifc", k, t[2], None, t[0]) for k, t in IFC_TYPES.items()]
    return spark.createDataFrame(rows, "scheme string, class_id int, name string, colour string, description string")
