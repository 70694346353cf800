"""Relations of the engine and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PROVISION = T.StructType(_strings("provision_id", "standard", "section_id", "title", "text", "modality"))
TRUTH = T.StructType([*_strings("src_id", "tgt_id", "relationship", "justification"), T.StructField("confidence", T.IntegerType())])
#: One row for each prediction of any method; score is null for methods that only label.
PREDICTION = T.StructType([*_strings("method", "src_id", "tgt_id"), T.StructField("score", T.DoubleType()), *_strings("predicted_rel")])
PAIR = T.StructType(_strings("src_id", "tgt_id", "src_text", "tgt_text"))
DIMENSION = T.StructType(_strings("section_id", "title", "phase"))

NO_RELATION = "NO_RELATION"
SUBSUMPTION = "SUBSUMPTION"
# fixed values: relation labels, in the order in which answers are searched for them
LABELS = ["EQUIVALENCE", "SUBSUMPTION_A_BROADER", "SUBSUMPTION_B_BROADER", "OVERLAP", "COMPLEMENTARITY", "NO_RELATION"]
MODALITIES = ["shall", "should", "may", "unknown"]
# fixed values: lower bounds of the labels of lexical and of semantic scores
LEXICAL_CUTS = [(0.60, "EQUIVALENCE"), (0.35, "OVERLAP"), (0.15, "COMPLEMENTARITY")]
SEMANTIC_CUTS = [(0.85, "EQUIVALENCE"), (0.70, "OVERLAP"), (0.50, "COMPLEMENTARITY")]
# fixed values: least score of a pair that a method reports
PAIR_THRESHOLDS = {"tfidf": 0.10, "jaccard": 0.05, "sentence": 0.30, "encoder": 0.70, "domain_encoder": 0.70, "remote_embedding": 0.50}
#: Order of methods in reports.
METHOD_ORDER = ["tfidf", "jaccard", "sentence", "encoder", "domain_encoder", "remote_embedding", "remote_label"]

# fixed values: titles of the sections of EN 303 645
SECTIONS_A = [
    ("5.0", "Reporting implementation"),
    ("5.1", "No universal default passwords"),
    ("5.2", "Implement a means to manage reports of vulnerabilities"),
    ("5.3", "Keep software updated"),
    ("5.4", "Securely store sensitive security parameters"),
    ("5.5", "Communicate securely"),
    ("5.6", "Minimize exposed attack surfaces"),
    ("5.7", "Ensure software integrity"),
    ("5.8", "Ensure that personal data is secure"),
    ("5.9", "Make systems resilient to outages"),
    ("5.10", "Examine system telemetry data"),
    ("5.11", "Make it easy for users to delete user data"),
    ("5.12", "Make installation and maintenance of devices easy"),
    ("5.13", "Validate input data"),
]
# fixed values: titles and phases of the principles of EN 304 223
SECTIONS_B = [
    ("5.1.1", "Raise awareness of AI security threats and risks", "Secure Design"),
    ("5.1.2", "Design the AI system for security as well as functionality and performance", "Secure Design"),
    ("5.1.3", "Evaluate the threats and manage the risks to the AI system", "Secure Design"),
    ("5.1.4", "Enable human responsibility for AI systems", "Secure Design"),
    ("5.2.1", "Identify, track and protect the assets", "Secure Development"),
    ("5.2.2", "Secure the infrastructure", "Secure Development"),
    ("5.2.3", "Secure the supply chain", "Secure Development"),
    ("5.2.4", "Document data, models and prompts", "Secure Development"),
    ("5.2.5", "Conduct appropriate testing and evaluation", "Secure Development"),
    ("5.3.1", "Communication and processes associated with End-users and Affected Entities", "Secure Deployment"),
    ("5.4.1", "Maintain regular security updates, patches and mitigations", "Secure Maintenance"),
    ("5.4.2", "Monitor the system's behaviour", "Secure Maintenance"),
    ("5.5.1", "Ensure proper data and model disposal", "Secure End of Life"),
]
# fixed values: the security vocabulary of the keyword method
KEYWORDS = [
    "password", "authentication", "credential", "token", "certificate", "cryptography", "cipher", "hash", "signature", "tls", "ssl", "biometric", "brute", "force",
    "update", "patch", "firmware", "upgrade", "rollback",
    "vulnerability", "cve", "disclosure", "exploit", "remediation",
    "integrity", "authenticity", "availability", "confidentiality",
    "authorization", "privilege", "permission",
    "monitoring", "logging", "audit", "telemetry", "anomaly",
    "supply", "vendor",
    "poisoning", "adversarial", "inference", "inversion", "hallucination", "dataset",
    "injection", "validation", "sanitize",
    "encryption", "persistent", "sensitive", "parameter", "hardcoded",
    "network", "protocol", "firewall", "interface",
    "resilience", "outage", "recovery", "redundancy",
    "privacy", "deletion", "retention",
    "lifecycle", "disposal", "decommission",
    "risk", "assessment", "oversight", "threat",
]
