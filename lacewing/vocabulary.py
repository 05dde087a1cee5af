"""Controlled vocabularies and thresholds of the domain.

Fixed values: these tables must equal the published system's for equal results.
"""

# relation as written: canonical relation
RELATION_OF = {
    "causes": "causal_of", "cause": "causal_of", "caused_by": "causal_of", "causal_of": "causal_of", "leads_to": "causal_of", "results_in": "causal_of", "triggers": "causal_of",
    "risk_factor_for": "risk_factor_for", "predisposes_to": "risk_factor_for", "increases_risk_of": "risk_factor_for",
    "associated_with": "associated_with", "correlated_with": "associated_with", "linked_to": "associated_with", "related_to": "associated_with", "co_occurs_with": "associated_with",
    "exacerbates": "exacerbates", "worsens": "exacerbates", "aggravates": "exacerbates",
    "reduces": "reduces", "decreases": "reduces", "lowers": "reduces", "diminishes": "reduces", "alleviates": "reduces", "treats": "reduces", "treated_with": "reduces", "effective_for": "reduces", "inhibits": "reduces", "blocks": "reduces",
    "increases": "increases", "elevates": "increases", "heightens": "increases", "raises": "increases",
    "improves_function": "improves_function", "improves": "improves_function", "enhances": "improves_function", "facilitates": "improves_function",
    "prevents": "prevents", "protects_against": "prevents",
    "adverse_effect": "adverse_effect", "side_effect": "adverse_effect", "causes_harm": "adverse_effect",
    "has_diagnosis": "has_diagnosis", "diagnosed_with": "has_diagnosis",
    "exhibits_symptom": "exhibits_symptom", "presents_with": "exhibits_symptom", "displays": "exhibits_symptom",
}

CONTRADICTIONS = [
    ("reduces", "increases"), ("reduces", "exacerbates"), ("improves_function", "adverse_effect"), ("prevents", "causal_of"),
    ("prevents", "risk_factor_for"), ("causal_of", "reduces"), ("associated_with", "prevents"), ("increases", "prevents"),
]
CONTRADICTIONS_ARTICLE = [("treats", "causes"), ("inhibits", "activates"), ("increases", "decreases"), ("upregulates", "downregulates")]

SHORT_RELATIONS = {
    "inhibit": "inhibits", "inhibited": "inhibits", "treat": "treats", "treated": "treats", "cause": "causes", "caused": "causes",
    "activate": "activates", "activates": "activates", "associated with": "associated_with", "interacts with": "interacts_with",
}

# evidence bucket: claim types
BUCKETS = {
    "assessment": ["SYMPTOM_EXHIBITION", "FUNCTIONAL_PROFILE", "SEVERITY_CLASSIFICATION", "DIAGNOSTIC_ASSESSMENT", "DEVELOPMENTAL_POSITION", "CARE_GIVING_CONTEXT", "PREFERENCE"],
    "intervention": ["BEHAVIORAL_INTERVENTION", "EDUCATIONAL_INTERVENTION", "INTERVENTION_OUTCOME", "COMPARATIVE_OUTCOME", "COMPARATIVE", "COMPARISON"],
    "side_effect": ["ADVERSE_EFFECT", "RISK_FACTOR", "SERVICE_ACCESS", "PHARMACOLOGICAL_INTERVENTION", "PRESCRIPTION", "PRESCRIPTION_RATE"],
    "counterfactual": ["COMPARATIVE", "COMPARISON", "COMPARATIVE_OUTCOME", "INTERVENTION_OUTCOME", "ADVERSE_EFFECT", "RISK_FACTOR"],
}

SECTION_SCORES = {
    "results": 0.8, "discussion": 0.7, "abstract": 0.6, "introduction": 0.5, "content": 0.5, "methods": 0.3, "references": 0.1,
    "acknowledgments": 0.1, "funding": 0.1, "supplementary": 0.2, "header": 0.2, "figure_caption": 0.4,
}

# section label: patterns at the start of a lower-cased segment, in order
SECTION_LABELS = {
    "abstract": r"^abstract([^a-z0-9_]|$)|summary([^a-z0-9_]|$)",
    "introduction": r"^(introduction|background)([^a-z0-9_]|$)",
    "methods": r"^(methods?|methodology|materials|experimental)([^a-z0-9_]|$)",
    "results": r"^(results?|findings|outcomes?)([^a-z0-9_]|$)",
    "discussion": r"^(discussion|conclusion|implications)([^a-z0-9_]|$)",
    "references": r"^(references?|bibliography)([^a-z0-9_]|$)|^[0-9]+\.\s+[a-z0-9_]+.*et al",
    "acknowledgments": r"^(acknowledgments?|acknowledgements?)([^a-z0-9_]|$)",
    "funding": r"^(funding|grants?|financial)([^a-z0-9_]|$)",
    "supplementary": r"^(supplement|appendix([^a-z0-9_]|$)|additional([^a-z0-9_]|$))",
}
# heading type: patterns at the start of a normalised heading, in order
HEADING_TYPES = {
    "abstract": r"^(abstract|summary)([^a-z0-9_]|$)",
    "introduction": r"^(introduction|background)([^a-z0-9_]|$)",
    "participants": r"^(participants?|subjects?|sample|study population)([^a-z0-9_]|$)",
    "intervention": r"^((interventions?|treatments?|procedure)([^a-z0-9_]|$)|study procedure)",
    "outcomes": r"^(outcome|(measures?|assessments?|instruments?)([^a-z0-9_]|$))",
    "results": r"^(results?|findings?)([^a-z0-9_]|$)",
    "methods": r"^((methods?|materials and methods)([^a-z0-9_]|$)|methodolog)",
    "discussion": r"^discussion([^a-z0-9_]|$)",
    "conclusion": r"^(conclusions?([^a-z0-9_]|$)|concluding)",
    "supplementary": r"^(supplement|appendix|supporting information)",
    "title": r"^title([^a-z0-9_]|$)",
}
# canonical section names of the quality screen: whole-line patterns
SCREEN_SECTIONS = {
    "abstract": "abstract|summary",
    "introduction": "introduction|background",
    "methods": "methods?|methodology|materials( and methods)?|experimental",
    "results": "results?( and aims|/aims)?|findings|outcomes?",
    "discussion": "discussion|conclusions?|implications",
    "references": "references?|bibliography",
    "acknowledgments": "acknowledge?ments?",
    "funding": "funding( information)?|grants?|financial",
    "supplementary": r"supplement(ary)?|appendi(x|ces)|additional( information)?",
}
HEDGES = "not|no|without|denied|unable|fail|fails|failed|doubt|uncertain|may|might|possibly|likely|unclear|inconclusive|appear|seem|seems"
HIGH_VALUE_TERMS = [
    "inhibit", "activate", "regulate", "express", "bind", "interact", "cause", "treat", "prevent", "induce", "suppress", "enhance", "protein", "gene",
    "enzyme", "receptor", "pathway", "mechanism", "disease", "cancer", "tumor", "therapy", "treatment", "drug", "significant", "increase", "decrease", "effect", "response",
]
UNICODE_NAMES = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "μ": "mu", "°": " degrees", "±": "+/-",
    "→": " -> ", "←": " <- ", "↑": " up ", "↓": " down ",
}
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa",
    "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon",
    "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
UNITS = {
    "°C": " degrees Celsius", "°F": " degrees Fahrenheit", "±": " plus/minus ", "≤": " less than or equal to ", "≥": " greater than or equal to ",
    "→": " leads to ", "←": " derived from ", "↑": " increases ", "↓": " decreases ",
}
CRITIC_WEIGHTS = [0.30, 0.20, 0.20, 0.15, 0.15]
STRATEGY_TYPES = ("Therapeutic_Approach", "Educational_Approach", "Medication")
LOW_PRIORITY_CLAIMS = ("METHOD_DESIGN", "OTHER", "PREVALENCE", "SERVICE_ACCESS")
HIGH_IMPACT_TYPES = ("Medication", "Adverse_Effect", "Risk_Factor", "Therapeutic_Approach", "Healthcare_Access", "Institutional_System")
SCOPE_TYPES = ("SEVERITY_CLASSIFICATION", "RISK_FACTOR", "DOSE_RESPONSE", "INTERVENTION_OUTCOME", "COMPARATIVE_OUTCOME", "COMPARATIVE_SEVERITY", "COMPARATIVE_RISK")
SCOPE_KEYS = ("population", "severity", "developmental_stage", "dose_or_intensity", "timepoint", "comparator")
