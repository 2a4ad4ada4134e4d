"""Closed vocabularies and model constants."""

from __future__ import annotations

# They must equal those of the data hub for right results.
MATERIALS = [
    "Aluminium", "Asphalt", "Beton", "Bitumen", "Blähbeton", "Blei", "Diverse Kunststoffe", "Eternit", "Estrich",
    "Fliesen", "Fliesenkleber", "Glas", "Heraklith", "Holz", "Kautschuk", "Keramik", "Kupfer", "Laminat", "Linol",
    "Messing", "Mineralfaser", "Mineralwolle", "Mörtel", "Naturstein", "Papier", "Putz", "PVC", "Rigips", "Schlacke",
    "Schüttung", "Stahl", "Steinzeug", "Stroh", "Styropor", "Teppich", "Terrazzo", "Ytong", "Ziegel",
]
MATERIAL_GROUPS = {
    "Mineralik": ["Ziegel", "Beton", "Asphalt", "Blähbeton", "Eternit", "Estrich", "Fliesen", "Keramik", "Fliesenkleber", "Glas", "Mineralfaser", "Mörtel", "Putz", "Schüttung", "Ytong", "Rigips", "Steinzeug"],
    "Metalle": ["Aluminium", "Blei", "Kupfer", "Stahl", "Messing"],
    "Biomasse": ["Holz", "Heraklith", "Laminat", "Papier", "Stroh", "Linol"],
    "Kunststoffe": ["Diverse Kunststoffe", "PVC", "Styropor"],
}
PERIODS = {0: "unbekannt", 1: "bis 1918", 2: "1919-1944", 3: "1945-1979", 4: "1980-1999", 5: "ab 2000"}
UNKNOWN_LAYER = "Unbekannt"
PART_TYPES = ["Bodenaufbau", "Dachaufbau", "Innenwand", "Außenwand", "Brandwand", "Kniestock", "Attika"]
OBJECT_TYPES = ["Abhängung", "Tür", "Zarge", "Fenster", "Heizkörper", "Rohre", "Kabel", "Sonstige"]
LISTING_UNITS = ["Stück", "Kubikmeter", "Quadratmeter", "Meter", "Kilogramm"]
#: Hub material -> catalog materials, best candidate first.
ALIASES = {
    "Beton": ["STB", "Beton", "Betonfertigteil"], "Blähbeton": ["Leichtbeton"], "Ytong": ["Leichtbeton"],
    "Mineralwolle": ["Dämmung-weich"], "Mineralfaser": ["Dämmung-weich"], "Styropor": ["Styropor", "Dämmung-hart"],
    "Rigips": ["Gips", "Rigipswand"], "Naturstein": ["Stein"], "Eternit": ["Faserzement"], "Fliesen": ["Keramik"],
    "Steinzeug": ["Keramik"], "Bitumen": ["Bitumen", "Abdichtung"], "Asphalt": ["Abdichtung"],
    "Heraklith": ["Heraklith", "Heraklith/Holz"], "Stahl": ["Stahl", "Stahlträger", "Metall"],
    "Aluminium": ["Aluminium", "Metall"], "Kupfer": ["Metall"], "Messing": ["Metall"], "Blei": ["Metall"],
}
#: What clients send -> the catalog's period, place and kind.
CLIENT_PERIODS = {"vor 1919": "bis 1918", "nach 2000": "ab 2000"}
CLIENT_PLACES = {"Kellergeschoss": "KG", "Regelgeschoss": "RG", "D": "DG", "Dach": "DG"}
CLIENT_KINDS = {
    "Innenwand": "IW", "Außenwand": "AW", "BW": "AW", "Brandwand": "AW", "BA": "FB", "Bodenaufbau": "FB", "DA": "D",
    "Dachaufbau": "D", "KS": "AW", "Kniestock": "AW", "A": "AW", "Attika": "AW",
}
#: Labels and details of the plausibility answer.
ANSWERS = {
    "unknown": ("neues/unbekanntes Material", "unbekannt: "),
    "reversed": ("vermutlich UMGEKEHRT eingegeben", "die Umkehrung ergibt einen typischen Aufbau"),
    "impossible": ("unplausibel", "enthält eine nie gesehene Materialfolge"),
    "usual": ("passt ins übliche Bild", "im Referenzbereich"),
    "unusual": ("ungewöhnliche Kombination", "unter dem Referenzbereich"),
}
#: Densities [kg/m³].
DENSITY = {
    "Ziegel": 1800, "Vollziegel": 2000, "Beton": 2300, "STB": 2400, "Leichtbeton": 1200, "Betonfertigteil": 2400,
    "Betonträger/Untezug": 2400, "Stein": 2600, "Unterzug": 2400, "Wand": 1800, "Stiegen": 2400, "Stiegenhaus": 2400,
    "Putz": 1600, "Putzträger": 1600, "Gips": 1000, "Estrich": 2100, "Schüttung": 1600, "Dämmung-weich": 40,
    "Dämmung-hart": 150, "Styropor": 20, "Heraklith": 450, "Heraklith/Holz": 450, "Glas": 2500, "Keramik": 2000,
    "Wandfliesen": 2000, "Faserzement": 1700, "Dachfenster": 2500, "Bitumen": 1050, "Abdichtung": 1000,
    "Dachschindeln": 1100, "Dachaufbau": 1000, "Dachlucke": 2500, "Rigipswand": 900,
}
DENSITY |= dict.fromkeys(["Stahl", "Stahlträger", "IPE", "IPE 140", "IPE Träger", "Rundeisen", "Träger", "Gitterträger", "Metall", "Blech", "Blechdach", "Trockenbauprofil", "Blitzableiter", "Dachrinne", "Geländer", "Geländersteher", "Lawinengitter"], 7850)
DENSITY |= dict.fromkeys(["Holz", "Holzschalung", "Holztram", "Holzträger", "Sparren", "Latten", "Ziegellatten", "Pfetten", "Querpfetten", "Längspfetten", "Querbalken", "Längsbalken", "Bodensparren", "Bodenbretter", "Pfosten", "Säulen", "Dippelbaum", "Dippelboden", "Tramdecke", "Wandverkleidung", "Unterkonstruktion", "Ausfachung", "Ausspreizung", "Aussteifung"], 500)
DENSITY_DEFAULT = 1500
#: Metric -> (value by period code, fallback).
PERIOD_METRICS = {
    "wall_thickness_m": ({1: 0.70, 2: 0.60, 3: 0.50, 4: 0.40, 5: 0.35}, 0.60),
    "interior_wall_lfm_per_m2": ({1: 0.50, 2: 0.50, 3: 0.53, 4: 0.55, 5: 0.58}, 0.50),
    "storey_height_m": ({1: 3.5, 2: 3.2}, 3.0),
    "keller_geschosse": ({}, 1.0),
    "dachgeschosse": ({}, 1.0),
    "roof_area_factor": ({}, 1.2),
}
#: Interior walls by period code: build-up (material, thickness in m) of each kind.
IW_LAYERS = {
    "tragend": {0: [("Putz", 0.015), ("Ziegel", 0.45), ("Putz", 0.015)], 1: [("Putz", 0.015), ("Ziegel", 0.45), ("Putz", 0.015)], 2: [("Putz", 0.015), ("Ziegel", 0.42), ("Putz", 0.015)], 3: [("STB", 0.15)], 4: [("STB", 0.18)], 5: [("STB", 0.18)]},
    "wohnung": {0: [("Putz", 0.015), ("Ziegel", 0.29), ("Putz", 0.015)], 1: [("Putz", 0.015), ("Ziegel", 0.29), ("Putz", 0.015)], 2: [("Putz", 0.015), ("Ziegel", 0.29), ("Putz", 0.015)], 3: [("Ziegel", 0.25)], 4: [("Beton", 0.25)], 5: [("STB", 0.20)]},
    "leicht": {0: [("Putz", 0.015), ("Ziegel", 0.14), ("Putz", 0.015)], 1: [("Putz", 0.015), ("Ziegel", 0.14), ("Putz", 0.015)], 2: [("Putz", 0.010), ("Ziegel", 0.12), ("Putz", 0.010)], 3: [("Putz", 0.010), ("Ziegel", 0.12), ("Putz", 0.010)], 4: [("Gips", 0.025)], 5: [("Gips", 0.025)]},
}
#: Running metres per net m², and the share of openings.
IW_LFM = {"tragend": {0: 0.125, 1: 0.125, 2: 0.10, 3: 0.10, 4: 0.04, 5: 0.04}, "leicht": {0: 0.175, 1: 0.175, 2: 0.35, 3: 0.35, 4: 0.285, 5: 0.285}}
OPEN_AW = {0: 0.20, 1: 0.20, 2: 0.25, 3: 0.25, 4: 0.30, 5: 0.37}
OPEN_IW = {"tragend": {0: 0.12, 1: 0.12, 2: 0.07, 3: 0.07, 4: 0.03, 5: 0.03}, "leicht": {0: 0.25, 1: 0.25, 2: 0.17, 3: 0.17, 4: 0.32, 5: 0.32}}
#: Thickness below which a material's layer keeps its own value.
FIXED_LAYER_M = 0.03
#: Options of the price slider: (up to, step).
PRICE_STEPS = [(250, 10), (1000, 50), (1500, 100), (3000, 500), (10000, 1000), (100000, 10000)]

#: Usual thickness of a layer in mm, by material; FALLBACK_MM for all others.
LAYER_MM = {
    "Aluminium": 3, "Asphalt": 30, "Beton": 200, "Bitumen": 4, "Blähbeton": 200, "Blei": 2, "Diverse Kunststoffe": 5,
    "Eternit": 6, "Estrich": 60, "Fliesen": 10, "Fliesenkleber": 5, "Glas": 6, "Heraklith": 35, "Holz": 24, "Kautschuk": 4,
    "Keramik": 10, "Kupfer": 1, "Laminat": 8, "Linol": 3, "Messing": 2, "Mineralfaser": 20, "Mineralwolle": 120,
    "Mörtel": 12, "Naturstein": 30, "Papier": 1, "Putz": 15, "PVC": 2, "Rigips": 12, "Schlacke": 80, "Schüttung": 60,
    "Stahl": 5, "Steinzeug": 10, "Stroh": 400, "Styropor": 100, "Teppich": 8, "Terrazzo": 20, "Ytong": 250, "Ziegel": 300,
}
FALLBACK_MM = 50
