"""Fixed values.

Everything in this module is a constant that results depend on byte for byte:
text templates, id prefixes, null defaults, seed rows, word lists and limits.
Nothing here is logic.  Templates name canonical columns in braces.
"""

# --------------------------------------------------------------------------
# Markers a delimited dictionary uses for "no value"
# --------------------------------------------------------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --------------------------------------------------------------------------
# limits
# --------------------------------------------------------------------------
EMBED_DIM = 384
ENCODE_BATCH = 64
SHORT_NAME_CHARS = 100
PAGE_ROWS = 2_000
MIN_PAYLOAD_CHARS = 200
CLI_TOP_K = 5
DEFAULT_RESULTS = 5
OVERFETCH = 2
DEFAULT_MAX_DISTANCE = 1.5
OBSERVATIONS_PER_MATCH = 50
OBSERVATIONS_DEFAULT = 25

# --------------------------------------------------------------------------
# Model-embedded registries.  Blank policy: null becomes "".
# --------------------------------------------------------------------------
MODEL_REGISTRIES = {
    "usaid": {
        "display": "USAID DHS Indicators",
        "source": "usaid_dhs",
        "columns": ["IndicatorId", "Label", "Definition", "ShortName"],
        "dedup": "IndicatorId",
        "id": "usaid_{IndicatorId}",
        "indicator": "IndicatorId",
        "document": "Source: USAID DHS. Label: {Label}. Definition: {Definition}",
        "short_name": "ShortName",
        "metadata": {"label": "Label", "short_name": "ShortName"},
        "on_missing": "raise",
    },
    "who": {
        "display": "WHO GHO Registry",
        "source": "who_gho",
        "columns": ["IndicatorCode", "IndicatorName", "Language"],
        "language": "EN",
        "id": "who_{IndicatorCode}",
        "indicator": "IndicatorCode",
        "document": "Source: WHO GHO. Indicator Code: {IndicatorCode}. Indicator Name: {IndicatorName}",
        "short_name": "IndicatorName[:100]",
        "metadata": {"indicator_id": "IndicatorCode", "short_name": "IndicatorName[:100]"},
        "on_missing": "raise",
    },
    "nih_allofus": {
        "display": "NIH All of Us Codebook",
        "source": "nih_allofus",
        "columns": ["concept_id", "question_code", "question_text"],
        "backfill": ["concept_id", "question_code", "question_text"],
        "id": "allofus_{question_code or concept_id or row_index}",
        "indicator": "question_code or concept_id or row_index",
        "document": "Source: NIH All of Us. Concept ID: {concept_id}. Question Code: {question_code}. Text: {question_text}",
        "short_name": "question_text[:100]",
        "metadata": {"concept_id": "concept_id", "short_name": "question_text[:100]"},
        "on_missing": "seed",
        "seed": [
            {"concept_id": "1", "question_code": "PM_001", "question_text": "Demographics and Baseline Survey"},
            {"concept_id": "2", "question_code": "PM_002", "question_text": "Overall Health Survey"},
        ],
    },
    "mimic_iv": {
        "display": "MIMIC-IV Clinical Dictionary",
        "source": "mimic_iv",
        "columns": ["itemid", "label", "category", "unitname"],
        "backfill": ["category", "unitname"],
        "id": "mimic_{itemid}",
        "indicator": "itemid",
        "document": "Source: MIMIC-IV. Item ID: {itemid}. Label: {label}. Category: {category}. Unit: {unitname}",
        "short_name": "label[:100]",
        "metadata": {"item_id": "itemid", "short_name": "label[:100]"},
        "on_missing": "seed",
        "seed": [
            {"itemid": "220045", "label": "Heart Rate", "abbreviation": "HR",
             "category": "Routine Vital Signs", "unitname": "bpm"},
        ],
    },
    "nhanes": {
        "display": "CDC NHANES Variables",
        "source": "cdc_nhanes",
        "columns": ["Variable", "Description", "Target"],
        "id": "nhanes_{Variable}",
        "indicator": "Variable",
        "document": "Source: CDC NHANES. Variable: {Variable}. Description: {Description}. Target Demographic: {Target}",
        "short_name": "Description[:100]",
        "metadata": {"variable": "Variable", "short_name": "Description[:100]"},
        "on_missing": "seed",
        "seed": [
            {"Variable": "LBXGLU", "Description": "Fasting Glucose (mg/dL)",
             "Target": "Both males and females 12 YEARS - 150 YEARS"},
            {"Variable": "BPXSY1", "Description": "Systolic: Reading 1",
             "Target": "Both males and females 8 YEARS - 150 YEARS"},
            {"Variable": "RIDAGEYR", "Description": "Age in years at screening",
             "Target": "Both males and females 0 YEARS - 150 YEARS"},
        ],
    },
    "uk_biobank": {
        "display": "UK Biobank Showcase",
        "source": "uk_biobank",
        "columns": ["field_id", "title"],
        "detect": True,
        "dedup": "field_id",
        "id": "ukbb_{field_id}",
        "indicator": "field_id",
        "document": "Source: UK Biobank. Field ID: {field_id}. Title: {title}",
        "short_name": "title",
        "metadata": {"field_id": "field_id", "title": "title"},
        "on_missing": "skip",
    },
}

# --------------------------------------------------------------------------
# Hash-embedded registries.  Labelled defaults replace nulls.
# --------------------------------------------------------------------------
HASH_REGISTRIES = {
    "usaid": {
        "display": "USAID DHS",
        "source": "USAID_DHS",
        "columns": ["IndicatorId", "Label", "ShortName", "Definition"],
        "fill": {"Label": "Unknown Indicator", "ShortName": "Unknown Short Label",
                 "Definition": "No Context Clarified"},
        "dedup": "IndicatorId",
        "id": "DHS_{IndicatorId}",
        "indicator": "IndicatorId",
        "document": "Source: USAID DHS | Indicator: {Label} | Definition: {Definition or Label}",
        "short_name": "ShortName",
        "on_missing": "raise",
    },
    "who": {
        "display": "WHO GHO",
        "source": "WHO_GHO",
        "rename": {"IndicatorCode": "Code", "IndicatorName": "Name"},
        "columns": ["Code", "Name"],
        "fill": {"Code": "UNKNOWN", "Name": "Unknown WHO Indicator"},
        "dedup": "Code",
        "id": "WHO_GHO_{Code}",
        "indicator": "Code",
        "document": "Source: WHO GHO | Indicator Code: {Code} | Name: {Name}",
        "short_name": "Name[:100]",
        "on_missing": "seed",
        "seed": [
            {"IndicatorCode": "WHOSIS_000001", "IndicatorName": "Life expectancy at birth (years)"},
            {"IndicatorCode": "WHOSIS_000002", "IndicatorName": "Healthy life expectancy (HALE) at birth (years)"},
            {"IndicatorCode": "WHOSIS_000015",
             "IndicatorName": "Adult mortality rate (probability of dying between 15 and 60 years per 1000 population)"},
        ],
    },
    "mimic_iv": {
        "display": "MIMIC-IV",
        "source": "MIMIC_IV",
        "rename": {"itemid": "ItemID", "label": "Label", "fluid": "Fluid", "category": "Category"},
        "columns": ["ItemID", "Label", "Fluid", "Category"],
        "fill": {"ItemID": "0", "Label": "Unknown Item", "Fluid": "Unspecified", "Category": "General Lab"},
        "dedup": "ItemID",
        "id": "MIMIC_ITEM_{ItemID}",
        "indicator": "ItemID",
        "document": "Source: MIMIC-IV | ItemID: {ItemID} | Label: {Label} | Fluid: {Fluid} | Category: {Category}",
        "short_name": "Label[:100]",
        "on_missing": "seed",
        "seed": [
            {"itemid": "50868", "label": "Anion Gap", "fluid": "Blood", "category": "Chemistry"},
            {"itemid": "50882", "label": "Bicarbonate", "fluid": "Blood", "category": "Chemistry"},
            {"itemid": "50912", "label": "Creatinine", "fluid": "Blood", "category": "Chemistry"},
        ],
    },
    "nih_allofus": {
        "display": "NIH All of Us",
        "source": "NIH_ALLOFUS",
        "rename": {"concept_id": "ConceptID", "concept_name": "ConceptName",
                   "domain_id": "DomainID", "vocabulary_id": "VocabularyID"},
        "columns": ["ConceptID", "ConceptName", "DomainID", "VocabularyID"],
        "fill": {"ConceptID": "0", "ConceptName": "Unknown Concept",
                 "DomainID": "General Domain", "VocabularyID": "Standard Vocab"},
        "dedup": "ConceptID",
        "id": "ALLOFUS_CONCEPT_{ConceptID}",
        "indicator": "ConceptID",
        "document": "Source: NIH All of Us | Concept ID: {ConceptID} | Name: {ConceptName} | Domain: {DomainID} | Vocabulary: {VocabularyID}",
        "short_name": "ConceptName[:100]",
        "on_missing": "seed",
        "seed": [
            {"concept_id": "21600712", "concept_name": "Amlodipine 5 MG Oral Tablet",
             "domain_id": "Drug", "vocabulary_id": "RxNorm"},
            {"concept_id": "316866", "concept_name": "Hypertensive disorder",
             "domain_id": "Condition", "vocabulary_id": "SNOMED"},
            {"concept_id": "4329847", "concept_name": "Body mass index (BMI)",
             "domain_id": "Measurement", "vocabulary_id": "LOINC"},
        ],
    },
    "nhanes": {
        "display": "CDC NHANES",
        "source": "NHANES",
        "rename": {"variable_id": "VariableID", "sas_label": "SASLabel", "question_text": "QuestionText"},
        "columns": ["VariableID", "SASLabel", "QuestionText"],
        "fill": {"VariableID": "UNKNOWN_VAR", "SASLabel": "Unknown Factor",
                 "QuestionText": "No Context Clarified"},
        "dedup": "VariableID",
        "id": "NHANES_VAR_{VariableID}",
        "indicator": "VariableID",
        "document": "Source: CDC NHANES | Variable: {VariableID} | Label: {SASLabel} | Question: {QuestionText}",
        "short_name": "SASLabel[:100]",
        "on_missing": "seed",
        "seed": [
            {"VariableID": "RIAGENDR", "SASLabel": "Gender", "QuestionText": "'Gender of the participant.'"},
            {"VariableID": "BPXSY1", "SASLabel": "Systolic: Blood Pres 1st rdg mm Hg",
             "QuestionText": "'Systolic blood pressure, first reading.'"},
            {"VariableID": "DIQ010", "SASLabel": "Doctor told you have diabetes",
             "QuestionText": "'Have you ever been told by a doctor or health professional that you have diabetes?'"},
        ],
    },
    "uk_biobank": {
        "display": "UK Biobank",
        "source": "UK_Biobank",
        "rename": {"field_id": "FieldID", "title": "Field", "notes": "Category"},
        "columns": ["FieldID", "Field", "Category"],
        "fill": {"FieldID": "UNKNOWN", "Field": "Unknown Field Description", "Category": "General Health"},
        "dedup": "FieldID",
        "id": "UKB_FIELD_{FieldID}",
        "indicator": "FieldID",
        "document": "Source: UK Biobank | Field ID: {FieldID} | Category: {Category} | Description: {Field}",
        "short_name": "Field[:100]",
        "on_missing": "seed",
        "seed": [
            {"FieldID": "31", "Field": "Sex", "Category": "Baseline characteristics"},
            {"FieldID": "93", "Field": "Systolic blood pressure, automated reading", "Category": "Blood pressure"},
            {"FieldID": "2443", "Field": "Diabetes diagnosed by doctor", "Category": "Medical conditions"},
        ],
    },
}

# --------------------------------------------------------------------------
# Unified five-column registries (columns in unified order)
# --------------------------------------------------------------------------
UNIFIED_COLUMNS = ["source_dataset", "table_id", "variable_id", "variable_name", "description"]
UNIFIED_REGISTRIES = {
    "nhanes": {
        "source": "NHANES",
        "table_id": "Component",
        "variable_id": "Item/Code",
        "variable_name": "Item/Code",
        "description": "Description",
        "seed": [
            {"Component": "Demographics", "Item/Code": "RIAGENDR",
             "Description": "Gender of the participant. 1=Male, 2=Female."},
            {"Component": "Examination", "Item/Code": "BMXBMI",
             "Description": "Body Mass Index (kg/m**2) calculated for selected age ranges."},
        ],
    },
    "uk_biobank": {
        "source": "UK_Biobank",
        "table_prefix": "Cat",
        "table_id": "Category",
        "variable_id": "FieldID",
        "variable_name": "Title",
        "description": "Description",
        "seed": [
            {"FieldID": "21001", "Title": "Body mass index (BMI)",
             "Description": "Anthropometric measurement of weight divided by squared height.", "Category": "1001"},
            {"FieldID": "31", "Title": "Sex",
             "Description": "Genetic or phenotypic sex reported by participant.", "Category": "1002"},
        ],
    },
}
UNIFIED_ID = "{source_dataset}_{table_id}_{variable_id}"

# --------------------------------------------------------------------------
# Text patterns and separators
# --------------------------------------------------------------------------
CLEAN_PATTERN = r"[^a-zA-Z0-9\s\-_]"
RAGGED_DELIMITER = r"\t+|\s{2,}"
WORD_BREAK = r"[^\p{L}\p{N}]+"
TEXT_SEPARATOR = " | "

# --------------------------------------------------------------------------
# Header hints of the column detector
# --------------------------------------------------------------------------
ID_HEADER_HINTS = ("field", "id")
TITLE_HEADER_HINTS = ("title", "name", "desc")

# --------------------------------------------------------------------------
# Query labels and the substrings that trigger them, in order
# --------------------------------------------------------------------------
DEMOGRAPHICS = (
    ("Adult/Mature", ("adult", "elderly", "aged", "over 50", "senior")),
    ("Pediatric", ("child", "pediatric", "infant", "youth")),
    ("Gender-Specific", ("female", "women", "male", "men", "gender")),
)

# English function words left out of extracted keywords (a parameter's default)
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "before", "being", "between", "both",
    "but", "by", "can", "could", "did", "do", "does", "during", "each",
    "find", "for", "from", "get", "give", "had", "has", "have", "he", "her",
    "here", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "list", "many", "may", "me", "might", "more", "most", "much", "must",
    "my", "no", "nor", "not", "of", "on", "only", "or", "other", "our",
    "out", "over", "own", "please", "same", "shall", "she", "should", "show",
    "so", "some", "such", "tell", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "through", "to",
    "under", "until", "up", "us", "very", "was", "we", "were", "what",
    "when", "where", "which", "while", "who", "whom", "whose", "why", "will",
    "with", "would", "you", "your",
)

# --------------------------------------------------------------------------
# Metadata look-up order and defaults of search candidates
# --------------------------------------------------------------------------
UNKNOWN_SOURCE = "unknown"
RESOLVE_TABLE = (("field_id", "label"), "N/A")
RESOLVE_VARIABLE = (("field_id", "short_name", "IndicatorId"), "N/A")
RESOLVE_NAME = (("label", "title", "short_name"), "Indicator")

# --------------------------------------------------------------------------
# Observation routing (first matching family wins) and columns
# --------------------------------------------------------------------------
ROUTES = (
    ("WHO", ("who", "gho")),
    ("DHS", ("dhs", "usaid")),
    ("NHANES", ("nhanes",)),
)
NOT_AVAILABLE = "N/A"
DEFAULT_WIDE_TABLE = "DEMO_J"
WIDE_SOURCE = "NHANES"
WIDE_KEY = "SEQN"
WHO_COLUMNS = ["variable_id", "source_dataset", "SpatialDim", "TimeDim", "NumericValue", "Value"]
DHS_COLUMNS = ["variable_id", "source_dataset", "CountryName", "SurveyYear", "Value", "CharacteristicLabel"]

# --------------------------------------------------------------------------
# Context and prompt text
# --------------------------------------------------------------------------
CONTEXT_SEPARATOR = "\n\n"
PROMPT_TEMPLATE = "Context Blocks:\n{context}\n\nUser Question: {query}"
# {registers} is the name the deployment gives its set of registries
SYSTEM_PROMPT = (
    "You are an expert global health data translation assistant. Synthesize a concise, "
    "integrated answer to the user's question using ONLY the provided metadata context blocks. "
    "If the answer cannot be verified by the text snippets, explicitly state that the "
    "information is not available in the current {registers}. Do not invent details."
)
