"""Word lists, patterns and maps on which the results of the graph and text operators depend."""

# Node and edge types of the strict graph.
NODE_TYPES = ["Drug", "Target", "Pathway", "Animal Study", "Clinical Study", "Adverse Event", "Biomarker"]
EDGE_TYPES = ["tested_in", "associated_with", "observed_in", "linked_to"]

# Predicate of a statement -> type of its edge; any other is linked_to.
PREDICATES = {
    "inhibits": "associated_with",
    "activates": "associated_with",
    "binds": "associated_with",
    "targets": "associated_with",
    "causes": "observed_in",
    "treats": "associated_with",
    "metabolized_by": "associated_with",
    "induced": "observed_in",
    "decreased": "observed_in",
    "increased": "observed_in",
    "has_property": "linked_to",
    "part_of": "linked_to",
}

# Words of a name -> its node type, first hit wins.
TYPE_WORDS = [
    ("Clinical Study", ["study", "trial", "nct"]),
    ("Pathway", ["pathway", "signaling", "cycle"]),
    ("Target", ["hdac", "gene", "protein", "receptor", "enzyme"]),
    ("Adverse Event", ["syndrome", "disorder", "pain", "nausea", "vomiting", "fatigue", "toxicity"]),
    ("Biomarker", ["level", "concentration", "pk", "cmax"]),
]
# Names that are no entity.
GENERIC_WORDS = ["all teaes", "all deaths", "summary", "total", "study"]

# Objects of statements that become a property of the study or the drug.
STUDY_STATISTIC_WORDS = ["all teaes", "all deaths", "discontinu", "all serious", "all related", "grade 3-4", "study treatment", "phase 2", "clinical trial"]
DRUG_PROPERTY_WORDS = ["plasma level", "decline", "half-life", "cmax", "auc", "dosing", "schedule", "cycle", "administration", "infusion"]
# Adverse-event terms that are sums and become a property of the study.
SUMMARY_TERMS = ["all teaes", "all serious", "related teaes", "deaths", "discontinuation"]

# Vocabularies for grounding.
KNOWN_TARGETS = [
    "HDAC", "HDAC1", "HDAC2", "HDAC3", "HDAC6", "HDAC10", "HDAC11", "VEGF", "EGFR", "HER2", "PD-1",
    "PD-L1", "CTLA-4", "CD20", "CD30", "ALK", "ROS1", "BRAF", "MEK", "PI3K", "AKT", "MTOR",
    "BCL-2", "JAK", "STAT", "BTK", "FLT3", "KIT", "RET", "MET", "FGFR",
]
KNOWN_EVENTS = [
    "anemia", "neutropenia", "thrombocytopenia", "leukopenia", "febrile neutropenia", "pancytopenia", "lymphopenia", "coagulopathy",
    "nausea", "vomiting", "diarrhea", "constipation", "mucositis", "stomatitis", "abdominal pain", "dyspepsia", "gerd", "fecal incontinence",
    "fatigue", "pyrexia", "edema", "peripheral edema", "asthenia", "chills", "pain", "infusion site reaction", "weight decreased", "decreased appetite",
    "hypokalemia", "hyponatremia", "hypomagnesemia", "hyperglycemia", "hypocalcemia", "anorexia", "dehydration",
    "headache", "dizziness", "peripheral neuropathy", "dysgeusia", "insomnia", "paresthesia", "tremor",
    "dyspnea", "cough", "pneumonia", "upper respiratory tract infection",
    "rash", "pruritus", "alopecia", "dry skin", "erythema", "palmar-plantar erythrodysesthesia syndrome",
    "hypertension", "hypotension", "tachycardia", "qt prolongation", "thromboembolism",
]
KNOWN_BIOMARKERS = [
    "alp", "alkaline phosphatase", "alt", "alanine aminotransferase", "ast", "aspartate aminotransferase", "tbil", "total bilirubin", "dbil", "direct bilirubin",
    "cre", "creatinine", "bun", "blood urea nitrogen", "anc", "absolute neutrophil count", "wbc", "white blood cell", "hgb", "hemoglobin",
    "plt", "platelets", "alb", "albumin", "ldh", "lactate dehydrogenase",
]

# Gene -> chromosome, coordinates, length.
GENES = {
    "HDAC1": ("chr1", "32,291,921 – 32,333,635", "41,715 bp"),
    "HDAC2": ("chr6", "113,933,028 – 113,971,148", "38,121 bp"),
    "HDAC3": ("chr5", "141,620,778 – 141,636,867", "16,089 bp"),
    "HDAC4": ("chr2", "235,603,604 – 241,771,051", "~350,000 bp"),
    "HDAC5": ("chr17", "44,076,746 – 44,123,702", "46,956 bp"),
    "HDAC6": ("chrX", "48,801,377 – 48,824,986", "23,609 bp"),
    "HDAC7": ("chr12", "47,797,021 – 47,862,000*", "~65,000 bp"),
    "HDAC8": ("chrX", "72,345,000 – 72,490,924*", "~24,000 bp"),
    "HDAC9": ("chr7", "18,086,825 – 19,002,416", "915,591 bp"),
    "HDAC10": ("chr22", "50,245,183 – 50,251,405", "6,222 bp"),
    "HDAC11": ("chr3", "13,479,724 – 13,506,424", "26,700 bp"),
}

# Words of a heading -> section, first hit wins.
HEADER_RULES = [
    ("hepatotoxicity", "Hepatotoxicity"), ("liver injury", "Hepatotoxicity"), ("dili", "Hepatotoxicity"), ("liver", "Hepatotoxicity"),
    ("cardiac", "Cardiac Safety"), ("qtc", "Cardiac Safety"), ("ecg", "Cardiac Safety"),
    ("deaths", "Deaths and Serious Adverse Events"), ("mortality", "Deaths and Serious Adverse Events"), ("fatal", "Deaths and Serious Adverse Events"), ("serious adverse", "Deaths and Serious Adverse Events"),
    ("warning", "Monitoring and Warnings"), ("precaution", "Monitoring and Warnings"),
    ("adverse event", "Safety and Adverse Events"), ("adverse reaction", "Safety and Adverse Events"), ("safety", "Safety and Adverse Events"), ("tolerability", "Safety and Adverse Events"),
    ("efficacy", "Efficacy Outcomes"), ("response rate", "Efficacy Outcomes"), ("clinical response", "Efficacy Outcomes"), ("clinical outcome", "Efficacy Outcomes"), ("progression", "Efficacy Outcomes"), ("survival", "Efficacy Outcomes"), ("overall response", "Efficacy Outcomes"),
    ("pharmacokinetics", "Pharmacokinetics"), ("pk parameters", "Pharmacokinetics"), ("pharmacokinetic", "Pharmacokinetics"), ("absorption", "Pharmacokinetics"), ("distribution", "Pharmacokinetics"), ("elimination", "Pharmacokinetics"), ("metabolism", "Pharmacokinetics"),
    ("mechanism of action", "Mechanism of Action"), ("mechanism", "Mechanism of Action"), ("pharmacodynamics", "Mechanism of Action"),
    ("nonclinical", "Nonclinical Toxicology"), ("non-clinical", "Nonclinical Toxicology"), ("preclinical", "Nonclinical Toxicology"), ("animal", "Nonclinical Toxicology"), ("animal study", "Nonclinical Toxicology"), ("in vivo", "Nonclinical Toxicology"), ("in vitro", "Nonclinical Toxicology"),
    ("genotoxicity", "Genotoxicity"), ("mutagenicity", "Genotoxicity"), ("carcinogenicity", "Carcinogenicity"), ("reproductive", "Reproductive Toxicity"), ("teratogen", "Reproductive Toxicity"), ("embryo", "Reproductive Toxicity"),
    ("dosing regimen", "Dosing Regimen"), ("dose regimen", "Dosing Regimen"), ("administration", "Dosing Regimen"), ("recommended dose", "Dosing Regimen"), ("dose escalation", "Dosing Regimen"), ("dose level", "Dosing Regimen"),
    ("dose modification", "Dose Modifications"), ("dose reduction", "Dose Modifications"), ("dose interruption", "Dose Modifications"),
    ("study design", "Clinical Study Design"), ("study overview", "Clinical Study Design"), ("clinical study", "Clinical Study Design"), ("clinical trial", "Clinical Study Design"),
    ("eligibility", "Eligibility Criteria"), ("inclusion criteria", "Eligibility Criteria"), ("exclusion criteria", "Eligibility Criteria"),
    ("population characteristic", "Population Characteristics"), ("baseline characteristic", "Population Characteristics"), ("demographic", "Population Characteristics"), ("patient characteristic", "Population Characteristics"),
    ("hepatic impairment", "Special Populations – Hepatic"), ("renal impairment", "Special Populations"), ("special population", "Special Populations"), ("pediatric", "Special Populations"), ("geriatric", "Special Populations"),
    ("drug overview", "Drug Overview"), ("overview", "Drug Overview"), ("background", "Drug Overview"), ("introduction", "Drug Overview"),
    ("drug interaction", "Drug Interactions"), ("drug-drug interaction", "Drug Interactions"), ("cyp", "Drug Interactions"),
    ("formulation", "Formulation and Stability"), ("stability", "Formulation and Stability"), ("pharmaceutical", "Formulation and Stability"), ("reconstitution", "Formulation and Stability"),
    ("contraindication", "Contraindications"),
]

# Words of the first 800 characters -> section, first hit wins; a list inside needs all of its alternatives' groups.
CONTENT_RULES = [
    ([["hepatotoxicity", "hepatic failure", "liver failure"]], "Hepatotoxicity"),
    ([["qtc", "qt prolongation", "cardiac arrhythmia"]], "Cardiac Safety"),
    ([["death"], ["patient", "fatal"]], "Deaths and Serious Adverse Events"),
    ([["dose reduction", "dose modification", "dose interrupt"]], "Dose Modifications"),
    ([["auc", "cmax", "half-life", "clearance", "bioavailability", "elimination"]], "Pharmacokinetics"),
    ([["hdac", "histone deacetylase", "tubulin", "mechanism of action"]], "Mechanism of Action"),
    ([["rat ", "mouse ", "mice ", "dog ", "monkey ", "in vivo", "in vitro", "animal study", "repeat dose", "single dose toxicit"]], "Nonclinical Toxicology"),
    ([["genotoxic", "mutagenic", "ames test"]], "Genotoxicity"),
    ([["carcinogen"]], "Carcinogenicity"),
    ([["reproductive", "teratogen", "embryo"]], "Reproductive Toxicity"),
    ([["inclusion criteria", "exclusion criteria", "eligibility"]], "Eligibility Criteria"),
    ([["age ", "male", "female", "ecog", "baseline", "median age"]], "Population Characteristics"),
    ([["lyophilized", "reconstitut", "excipient", "shelf life", "storage condition"]], "Formulation and Stability"),
    ([["cyp3a", "cyp2c", "ugt1a1", "warfarin", "drug interaction"]], "Drug Interactions"),
    ([["mg/m2", "mg/m²", "infusion", "intravenous", "days 1-5", "21-day cycle"]], "Dosing Regimen"),
    ([["adverse", "teae", "side effect", "toxicity"]], "Safety and Adverse Events"),
    ([["orr", "response rate", "complete response", "partial response", "progression-free"]], "Efficacy Outcomes"),
]

# Patterns of the eligibility and pharmacokinetic cascades, first match wins. All ignore case.
# field -> (patterns, text for a match with the word, the word, text without it); {} is the value.
CASCADES = {
    "eligibility_anc_threshold": (
        [
            r"ANC\s*(?:>=|≥|>)\s*(\d+\.?\d*)\s*(?:x|×)\s*10(?:\^9|⁹)/L",
            r"absolute neutrophil count\s*(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10",
            r"neutrophil[s]?\s*(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10",
            r"ANC\s*(?:>=|≥)\s*(\d+)/mm",
            r"neutrophil count.*?(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10",
            r"adequate.*?bone marrow.*?ANC.*?(\d+\.?\d*)\s*(?:x|×)\s*10",
            r"WBC.*?(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10",
        ],
        ("10", "≥{} × 10⁹/L", "≥{}/mm³"),
    ),
    "eligibility_platelet_threshold": (
        [
            r"platelet[s]?\s*(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10(?:\^9|⁹)/L",
            r"platelet count\s*(?:>=|≥)\s*(\d+\.?\d*)\s*(?:x|×)\s*10",
            r"platelet[s]?\s*(?:>=|≥)\s*(\d+,?\d*)/mm",
            r"adequate.*?platelet.*?(\d+\.?\d*)\s*(?:x|×)\s*10",
        ],
        ("10", "≥{} × 10⁹/L", "≥{}/mm³"),
    ),
    "eligibility_creatinine_clearance": (
        [
            r"creatinine clearance\s*(?:>=|≥)\s*(\d+)\s*mL/min",
            r"CrCl\s*(?:>=|≥)\s*(\d+)\s*mL/min",
            r"calculated creatinine clearance\s*(?:>=|≥)\s*(\d+)",
            r"renal function.*?(\d+)\s*mL/min",
            r"adequate.*?renal.*?(\d+)\s*mL/min",
            r"Cockcroft-Gault.*?(\d+)\s*mL/min",
        ],
        ("", "≥{} mL/min", "≥{} mL/min"),
    ),
    "eligibility_bilirubin_threshold": (
        [
            r"(?:total\s+)?bilirubin\s*(?:<=|≤|<)\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
            r"(?:total\s+)?bilirubin\s*(?:<=|≤)\s*(\d+\.?\d*)\s*times?\s*(?:the\s+)?ULN",
            r"bilirubin\s*(?:<=|≤)\s*(\d+\.?\d*)\s*mg/dL",
            r"adequate.*?hepatic.*?bilirubin\s*(?:<=|≤)\s*(\d+\.?\d*)",
            r"bilirubin.*?must.*?(?:<=|≤)\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
        ],
        ("ULN", "≤{} × ULN", "≤{} mg/dL"),
    ),
    "eligibility_alt_ast_threshold": (
        [
            r"(?:ALT|AST|SGPT|SGOT)\s*(?:<=|≤)\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
            r"(?:ALT|AST)\s*(?:<=|≤)\s*(\d+\.?\d*)\s*times?\s*(?:the\s+)?ULN",
            r"transaminase[s]?\s*(?:<=|≤)\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
            r"liver enzyme[s]?\s*(?:<=|≤)\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
            r"adequate.*?hepatic.*?(?:ALT|AST)\s*(?:<=|≤)\s*(\d+\.?\d*)",
        ],
        ("", "≤{} × ULN", "≤{} × ULN"),
    ),
    "hepatic_impairment_exclusion": (
        [
            r"bilirubin\s*>\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN\s*(?:excluded|exclusion)",
            r"exclude[d]?\s*(?:if|when|with)\s*bilirubin\s*>\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
            r"hepatic impairment.*bilirubin\s*>\s*(\d+\.?\d*)\s*(?:x|×)\s*ULN",
        ],
        ("", "Bilirubin >{} × ULN excluded", "Bilirubin >{} × ULN excluded"),
    ),
    "cmax_value": (
        [r"(?:mean\s+)?Cmax.*?(\d+\.?\d*)\s*(?:μg/mL|ng/mL|mcg/mL)", r"peak.*?concentration.*?(\d+\.?\d*)\s*(?:μg/mL|ng/mL)"],
        ("", "{} μg/mL", "{} μg/mL"),
    ),
    "metabolism_pathway": (
        [r"metabolized.*?(?:via|by|through)\s+([A-Z0-9]+)", r"metabolism.*?pathway.*?([A-Z0-9]+)", r"(?:primarily|mainly)\s+metabolized\s+by\s+(?:hepatic\s+)?([A-Z0-9]+)"],
        ("", "{}", "{}"),
    ),
}
# Cascades of which a pattern may have two values: field -> [(pattern, text; {1} and {2} are its values)].
RANGE_CASCADES = {
    "auc_value": [
        (r"AUC[^.]*?(\d{1,3}(?:,\d{3})+)\s+to\s+(\d{1,3}(?:,\d{3})+)\s*(?:h·ng/mL|hong/mL|ng·h/mL|h\*ng/mL)", "{1} to {2} h·ng/mL"),
        (r"AUC[^.]*?(\d+\.?\d*)\s+to\s+(\d+\.?\d*)\s*(?:μg·h/mL|ng·h/mL|mcg\.h/mL)", "{1} to {2} h·ng/mL"),
        (r"(?:mean\s+)?AUC[^.]*?(\d+\.?\d*)\s*(?:μg·h/mL|ng·h/mL|mcg\.h/mL)", "{1} μg·h/mL"),
    ],
    "plasma_protein_binding": [
        (r"protein binding.*?(?:\d+\.?\d*%,?\s*)+and\s+(\d+\.?\d*)%\s*in.*?(?:man|human)", "{1}%"),
        (r"(\d+\.?\d*)\s*%\s*and\s*(\d+\.?\d*)\s*%.*?bound to.*?protein", "{1}-{2}%"),
        (r"(\d+\.?\d*)\s*%\s*bound to.*?protein", "{1}%"),
        (r"bound to protein.*?(\d+\.?\d*)\s*%", "{1}%"),
    ],
    "volume_of_distribution": [
        (r"V(?:d|ss).*?(\d+\.?\d*)\s*L", "{1} L"),
        (r"volume of distribution.*?(\d+\.?\d*)\s*L", "{1} L"),
        (r"volume of distribution.*?(approaches total body water)", "Approaches total body water"),
        (r"Vdss\s*approached\s*(total body water)", "Approaches total body water"),
    ],
}

# Weight of a field in the weighted accuracy; any other weighs 1.
FIELD_WEIGHTS = {
    "sponsor_information": 5, "primary_indication": 5, "dose_level": 4, "mechanism_of_action": 4, "adverse_events": 4, "study_id": 3, "n_patients": 3,
    "study_phase": 3, "safety_signals": 4, "pharmacokinetics": 3, "eligibility_criteria": 2, "notes": 1, "references": 1,
}
# Texts that count as empty when results are compared, and answers that are noise.
EMPTY_TEXTS = ["", "not found", "null", "none", "[]", "{}"]

# Section word -> schemas whose fields are asked for.
SECTION_SCHEMAS = {
    "metadata": ["StudyMetadata"],
    "population": ["PopulationCharacteristics"],
    "dosing": ["DosingAdministration", "TreatmentManagement"],
    "safety": ["SafetyData", "Contraindications", "DrugInteractions"],
    "adverse": ["SafetyData"],
    "efficacy": ["EfficacyOutcomes"],
    "response": ["EfficacyOutcomes"],
    "pharmacokinetics": ["Pharmacokinetics"],
    "pk": ["Pharmacokinetics"],
    "eligibility": ["EligibilityCriteria"],
    "inclusion": ["EligibilityCriteria"],
    "exclusion": ["EligibilityCriteria"],
    "mechanism": ["MechanismOfAction"],
    "toxicology": ["PreclinicalToxicology", "Genotoxicity", "Carcinogenicity", "ReproductiveToxicity"],
    "pre-clinical": ["PreclinicalToxicology"],
    "animal": ["PreclinicalToxicology"],
    "special": ["SpecialPopulations"],
    "formulation": ["FormulationStability"],
}
# Dose in mg/m2 for one in mg/kg.
KM_FACTORS = {"Rat": 6, "Dog": 20}

# Section -> key of the record that its answer fills; other sections fill the record itself.
SECTION_KEYS = {
    "Drug Overview": "study_metadata",
    "Clinical Study Design": "clinical_studies_data",
    "Population Characteristics": "clinical_studies_data",
    "Mechanism of Action": "mechanism_of_action",
    "Pharmacokinetics": "pharmacokinetics",
    "Efficacy Outcomes": "clinical_studies_data",
    "Safety and Adverse Events": "safety_data",
    "Hepatotoxicity": "safety_data",
    "Cardiac Safety": "safety_data",
    "Deaths and Serious Adverse Events": "safety_data",
    "Monitoring and Warnings": "safety_data",
    "Dosing Regimen": "dosing_administration",
    "Dose Modifications": "treatment_management",
    "Nonclinical Toxicology": "preclinical_toxicology",
    "Eligibility Criteria": "eligibility_criteria",
    "Special Populations – Hepatic": "special_populations",
    "Special Populations": "special_populations",
    "Drug Interactions": "drug_interactions",
    "Formulation and Stability": "formulation_stability",
    "Formulation": "formulation_stability",
    "Contraindications": "contraindications",
    "Genotoxicity": "genotoxicity",
    "Carcinogenicity": "carcinogenicity",
    "Reproductive Toxicity": "reproductive_toxicity",
}
# Fields of a nonclinical answer that belong to keys of their own.
NONCLINICAL_FIELDS = {
    "genotoxicity_in_vitro": "genotoxicity",
    "genotoxicity_in_vivo": "genotoxicity",
    "genotoxicity_conclusion": "genotoxicity",
    "carcinogenicity_studies_conducted": "carcinogenicity",
    "carcinogenicity_results": "carcinogenicity",
    "reproductive_toxicity_studies": "reproductive_toxicity",
    "reproductive_warnings": "reproductive_toxicity",
    "developmental_toxicity_warnings": "reproductive_toxicity",
}
# Section -> the section whose questions it gets, where that is another.
SECTION_ALIASES = {
    "Deaths and Serious Adverse Events": "Safety and Adverse Events",
    "Cardiac Safety": "Other",
    "Monitoring and Warnings": "Other",
    "Genotoxicity": "Nonclinical Toxicology",
    "Carcinogenicity": "Nonclinical Toxicology",
    "Reproductive Toxicity": "Nonclinical Toxicology",
    "Contraindications": "Other",
}
