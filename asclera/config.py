"""Lexicons, priors, relations and aliases as data. The defaults are clinical; every operator takes others."""

from __future__ import annotations

from dataclasses import dataclass, field

CATEGORIES = ("Dx", "Rx", "Proc", "Fup")

# The default clinical lexicon.
DX = [
    "syndrome", "disease", "disorder", "cancer", "carcinoma", "tumor", "infection", "deficiency", "failure",
    "insufficiency", "dysfunction", "neuropathy", "arthritis", "diabetes", "hypertension", "anemia", "hepatitis",
    "cirrhosis", "sepsis", "pneumonia", "asthma", "copd", "nephritis", "nephropathy", "sclerosis", "fibrosis",
    "stenosis",
]
RX = [
    "mg", "mcg", "tablet", "capsule", "dose", "injection", "infusion", "aspirin", "ibuprofen", "metformin", "insulin",
    "warfarin", "heparin", "statin", "atorvastatin", "lisinopril", "metoprolol", "amoxicillin", "prednisone",
    "albuterol", "omeprazole", "furosemide", "amlodipine", "losartan", "gabapentin", "levothyroxine", "clopidogrel",
    "ondansetron",
]
PROC = [
    "surgery", "procedure", "biopsy", "catheterization", "transplant", "resection", "excision", "repair", "replacement",
    "anastomosis", "nephrolithotomy", "nephrostomy", "endoscopy", "colonoscopy", "angioplasty", "stenting", "ablation",
    "dialysis", "chemotherapy", "radiotherapy", "radiation", "mri", "ct", "ultrasound", "x-ray", "echocardiography",
    "echocardiogram",
]
FUP = [
    "follow", "follow-up", "followup", "monitor", "monitoring", "recheck", "revisit", "repeat", "return", "clinic",
    "appointment", "schedule", "referral", "refer", "consultation", "consult", "check", "test", "retest", "screen",
    "surveillance",
]

# Word endings and doses that decide a category.
PROC_SUFFIX = r"(otomy|oscopy|ectomy|plasty|ography|ogram|gram)\b"
DX_SUFFIX = r"(itis|osis|emia|uria|pathy|trophy|plasia)\b"
DOSE_SEED = r"[0-9]+(mg|mcg|ml|%)"
DOSE = r"[0-9]+(mg|mcg|ml)"

# Qualifiers.
QUALIFIERS = {
    "negation": r"no|not|without|denies|negative|ruled\s+out|absent|never",
    "uncertainty": r"may|might|possibly|probable|likely|suspected|question\s+of|concern\s+for",
    "laterality": r"left|right|bilateral|unilateral",
}

# Weights of passages by the heading of a section.
SECTION_PRIORS = {
    "indication": 1.5, "indications": 1.5, "contraindication": 1.4, "contraindications": 1.4, "side effect": 1.3, "adverse": 1.3, "treatment": 1.3,
    "diagnosis": 1.4, "procedure": 1.3, "follow-up": 1.2, "dosage": 1.2, "mechanism": 1.1, "overview": 1.0, "description": 1.0,
}

# Relations kept in a subgraph.
SALIENT_RELATIONS = (
    "finding_of", "treats", "contraindicated_with", "associated_with", "is_a", "part_of", "causative_agent_of", "has_active_ingredient", "indicated_for", "has_finding_site",
)

# Preferred names, by vocabulary.
ALIASES = {
    "snomed": {
        "nephrostomy": "nephrostomy (procedure)", "nephrolithotomy": "percutaneous nephrolithotomy (procedure)", "diabetes": "diabetes mellitus (disorder)",
        "hypertension": "essential hypertension (disorder)", "pneumonia": "pneumonia (disorder)",
    },
    "rxnorm": {
        "aspirin": "aspirin (rxnorm:1191)", "metformin": "metformin (rxnorm:6809)", "furosemide": "furosemide (rxnorm:4603)", "lasix": "furosemide (rxnorm:4603)", "warfarin": "warfarin (rxnorm:11289)",
    },
}
VOCABULARY_OF = {"Dx": "snomed", "Proc": "snomed", "Rx": "rxnorm"}


@dataclass(frozen=True)
class Lexicon:
    """Seed words by category, and the endings that decide Proc and Dx."""

    words: dict[str, list[str]] = field(default_factory=lambda: {"Dx": DX, "Rx": RX, "Proc": PROC, "Fup": FUP})
    proc_suffix: str = PROC_SUFFIX
    dx_suffix: str = DX_SUFFIX
    dose_seed: str = DOSE_SEED
    dose: str = DOSE

    @property
    def seeds(self) -> list[str]:
        return [w for c in CATEGORIES for w in self.words[c]]
