"""Types of artifacts and the limits of retrieval, as parameters."""

from __future__ import annotations

# Artifact types with (searched by default, replaced by a day's digest).
TYPES = {
    "note": (True, True), "message": (True, True), "email": (True, True), "document": (True, True), "photo": (True, True), "video": (True, True),
    "contact": (True, False), "post": (True, True), "dev_session": (False, True), "visit": (False, True), "listening_session": (False, True),
    "browsing_session": (False, True), "digest": (True, False),
}
SEARCHABLE = [t for t, (s, _) in TYPES.items() if s]
DIGESTED = [t for t, (_, d) in TYPES.items() if d]
RRF_K, OVERFETCH, LEAST_K, MOST_K = 60, 5, 50, 500
RADIUS_KM, MOST_RADIUS_KM, NEAR_KM, FAR_KM = 25.0, 500.0, 50.0, 300.0
DIGEST_ROWS, DIGEST_CLIP, DIGEST_SPAN_DAYS = 200, 500, 14
NAME_CONFIDENCE, NAME_CAP = 0.7, 0.9
PHONE_DIGITS, PREVIEW_ROWS = 7, 10
CLUSTER_DECIMALS, CLUSTER_LEAST, RUN_LEAST, RUN_GAP_DAYS = 2, 5, 5, 1
BM25_K1, BM25_B = 1.2, 0.75
OCR_CHARS_A_PAGE, TEXT_CAP = 25, 12_000
# Relation labels and the relation they stand for.
RELATIONS = {
    "spouse": "spouse", "husband": "spouse", "wife": "spouse", "partner": "partner", "domestic partner": "domesticPartner", "domesticpartner": "domesticPartner",
    "child": "child", "son": "child", "daughter": "child", "parent": "parent", "mother": "mother", "mom": "mother", "father": "father", "dad": "father",
    "sibling": "sibling", "brother": "brother", "sister": "sister", "friend": "friend", "relative": "relative", "assistant": "assistant", "manager": "manager",
    "referred by": "referredBy", "referredby": "referredBy", "worksat": "worksAt", "employer": "worksAt",
}


def fetch_size(limit: int) -> int:
    return min(max(limit * OVERFETCH, LEAST_K), MOST_K)
