"""Fixed values of the experiment: codes, name corrections, variables and labels."""

from __future__ import annotations

# Treatments, in factor order, and the field codes for them.
TREATMENTS = ["AlpineControl", "AlpineWarmed", "SubalpineControl"]
EXCLUDED_TREATMENT = "SubalpineCooled"
TREATMENT_CODES = {
    "LT": "AlpineWarmed",
    "GT": "SubalpineCooled",
    "LC": "SubalpineControl",
    "GC": "AlpineControl",
}
ALPINE_SITE_TREATMENTS = ["AlpineControl", "SubalpineCooled"]
YEAR = 2021

# Planned contrasts and the two groups each one compares.
CONTRASTS = {
    "Warming effect": {"AlpineControl": -1.0, "AlpineWarmed": 1.0},
    "Warming lag": {"AlpineWarmed": -1.0, "SubalpineControl": 1.0},
}
CONTRAST_GROUPS = {
    "Warming effect": ("AlpineControl", "AlpineWarmed"),
    "Warming lag": ("SubalpineControl", "AlpineWarmed"),
    "Cooling lag": ("AlpineControl", "SubalpineCooled"),
}
OTHER_CONTRAST_GROUPS = ("SubalpineControl", "SubalpineCooled")

# Names set by hand for a submitted text.
NAME_OVERRIDES = {
    "Scorzo": "Scorzoneroides pyrenaica var. helvetica",
    "Salix arbacea": "Salix herbacea",
    "Cordus sp": "Carduus",
    "Futuma hemispherium": "Phyteuma betonicifolium",
    "Lechasyem vulgaris ?": "Leucanthemum vulgare",
}
# Resolved names known to be wrong.
REJECTED_NAMES = [
    "Ribes", "Eria", "Habenaria", "Inga", "Iodes", "Pera", "Placea", "Premna", "Raphia",
    "Trianthema", "Asteraceae", "Brassica",
]
# Species merged under one name.
SYNONYMS = {
    "Avenula versicolor": "Helictochloa versicolor",
    "Helictochloa versicolor subsp. versicolor": "Helictochloa versicolor",
    "Patzkea": "Patzkea paniculata subsp. paniculata",
    "Polygonum viviparum": "Bistorta vivipara",
    "Hypericum richeri subsp. richeri": "Hypericum richeri",
    "Viola": "Viola calcarata",
    "aaa +++ En attente de détermination": "Undetermined",
}
EXCLUDED_SPECIES = "Campanula scheuchzeri"

# Measured traits, one column each after the pivot.
TRAIT_CODES = ["D_Mass", "F_Mass", "L_Area", "H_Veg"]
UNUSED_TRAIT = "H_Repr"

# Which subplots count at which sites.
SUBPLOTS_BY_SITE = [(["GC", "LC", "LT"], ["D", "X"]), (["GT"], ["C"])]

# Parts of plot keys, for nutrients (LT03-17) and for traits (L_03_T).
NUTRIENT_PLOT = {"group": "^[A-Z]{2}", "rep": r"(?<=^[A-Z]{2})\d+", "individual": "(?<=-).*$"}
TRAIT_PLOT = {"site": "^[LG]", "treatment": "(?<=[0-9]_)[CT]", "rep": r"(?<=^[LGCT]_)\d+"}

# A species that is no part of a group, and the greatest plausible trait values.
MISPLACED = {"species": "Patzkea", "group": "AlpineControl"}
OUTLIERS = [("Anthyllis vulneraria", "height", 80), ("Hypericum richeri", "ldmc", 1000)]

# Microscope fields viewed per sample and a sample code to leave out.
MICROSCOPE_FIELDS = 30
EXCLUDED_SAMPLE_CODE = "LA"

# Columns whose gaps take the group mean, by treatment.
IMPUTED = {
    "SubalpineControl": [
        "srl", "rd", "rnc", "rtd", "below_productivity", "qpcr_root", "qpcr_soil", "tot_qpcr",
        "arbuscule",
    ],
    "AlpineControl": ["rate_green_teabag", "tot_decomp", "tot_qpcr", "qpcr_root"],
}

# Responses of the two model batches.
STRESS_VARIABLES = [
    "moisture", "soil_p_concentration", "soil_nitrate_concentration", "soil_temperature",
    "growing_season_length",
]
RESPONSE_VARIABLES = [
    "lma", "lnc", "rnc", "rtd", "srl", "rd", "vh", "above_productivity", "below_productivity",
    "rate_green_teabag", "rate_red_teabag", "qpcr_root", "qpcr_soil", "tot_qpcr", "arbuscule",
    "moisture", "soil_nitrate", "soil_p", "soil_om",
]
TRAITS = ["lma", "lnc", "rnc", "rtd", "srl", "rd", "vh"]
ABOVE_GROUND = ["lma", "lnc", "vh"]
TRAIT_KINDS = ("Above-ground traits", "Below-ground traits")
SITE_CONDITIONS = ["moisture", "soil_nitrate", "soil_p", "soil_temperature"]
FUNCTIONS = [
    "above_productivity", "below_productivity", "rate_green_teabag", "qpcr_root", "arbuscule",
]

# Types in plotting order, and what an unlisted variable gets.
TYPE_LEVELS = [
    "Plant size", "Conservation gradient", "Collaboration gradient",
    "Multitrophic interactions", "Ecosystem functions", "Environmental conditions",
]
DEFAULT_PLANT = "soil"
DEFAULT_CLASS = "ES"

# Variable, label, type, plant part, class.
VARIABLES = [
    ("lma", "LMA", "Conservation gradient", "Aboveground", "Functional traits"),
    ("lnc", "LNC", "Conservation gradient", "Aboveground", "Functional traits"),
    ("rtd", "RTD", "Conservation gradient", "Belowground", "Functional traits"),
    ("rnc", "RNC", "Conservation gradient", "Belowground", "Functional traits"),
    ("srl", "SRL", "Collaboration gradient", "Belowground", "Functional traits"),
    ("rd", "RD", "Collaboration gradient", "Belowground", "Functional traits"),
    ("vh", "VH", "Plant size", "Aboveground", "Functional traits"),
    ("above_productivity", "Aboveground \nproductivity", "Ecosystem functions",
     "Aboveground", "ES"),
    ("below_productivity", "Belowground \nproductivity", "Ecosystem functions",
     "Belowground", "ES"),
    ("rate_red_teabag", "Recalcitrant \nlitter decomposition", "Ecosystem functions",
     "Belowground", "ES"),
    ("rate_green_teabag", "Labile \nlitter decomposition", "Ecosystem functions",
     "Belowground", "ES"),
    ("ratio_decomp", "Labile/Recalcitrant litter decomposition", "Ecosystem functions",
     "Belowground", "ES"),
    ("tot_decomp", "Total decomposition rate", "Ecosystem functions", "Belowground", "ES"),
    ("qpcr_root", "Bacterial \nbiomass", "Multitrophic interactions", "Belowground", "ES"),
    ("qpcr_soil", "Bacterial biomass (sand)", "Multitrophic interactions", "Belowground", "ES"),
    ("tot_qpcr", "Bacterial biomass (root + sand)", "Multitrophic interactions",
     "Belowground", "ES"),
    ("arbuscule", "Arbuscular \ncolonization", "Multitrophic interactions",
     "Belowground", "ES"),
    ("moisture", "Moisture", "Environmental conditions", "soil", "EC"),
    ("soil_nitrate", "Nitrate concentration", "Environmental conditions", "soil", "EC"),
    ("soil_p", "Total P concentration", "Environmental conditions", "soil", "EC"),
    ("soil_om", "Organic matter concentration", "Environmental conditions", "soil", "EC"),
    ("soil_p_concentration", "Total P concentration", None, "soil", "EC"),
    ("soil_nitrate_concentration", "Nitrate concentration", None, "soil", "EC"),
    ("soil_temperature", "Soil temperature", None, "soil", "ES"),
    ("growing_season_length", "Growing season length", None, "soil", "ES"),
]

# Labels with units for the stress conditions, in plotting order.
STRESS_LABELS = {
    "Soil temperature": "July soil temperature (\u00b0C)",
    "Growing season length": "Growing season length (days)",
    "Moisture": "Moisture (%)",
    "Total P concentration": "Total P concentration (mg/kg)",
    "Nitrate concentration": "Nitrate concentration (mg/kg)",
}

# Term labels and their order in the two variance partitions.
STRESS_TERM_LABELS = {
    "soil_temperature": "Temperature",
    "Residual": "Residuals",
    "soil_p": "P concentration",
    "soil_nitrate": "Nitrate concentration",
    "moisture": "Moisture",
}
STRESS_TERM_LEVELS = [
    "Temperature", "Moisture", "P concentration", "Nitrate concentration", "Residuals",
]
FUNCTION_TERM_LABELS = {"ecc": "Experimental \n climate change", "Residual": "Residuals"}
FUNCTION_TERM_LEVELS = [
    "vh", "lma", "lnc", "vh:ecc", "lma:ecc", "lnc:ecc",
    "srl", "rd", "rnc", "rtd", "srl:ecc", "rd:ecc", "rnc:ecc", "rtd:ecc",
    "Experimental \n climate change", "Residuals",
]
