"""Fixed values that results depend on, stated plainly."""

from __future__ import annotations

# Weights of tournaments, tried in this order as parts of a name,
# and the weight of all others.
IMPORTANCE = [
    ("FIFA World Cup", 1.0),
    ("UEFA Euro", 0.9),
    ("Copa América", 0.9),
    ("AFC Asian Cup", 0.85),
    ("Gold Cup", 0.7),
    ("Africa Cup of Nations", 0.85),
    ("FIFA World Cup qualification", 0.7),
    ("UEFA Euro qualification", 0.65),
    ("FIFA Confederations Cup", 0.8),
    ("UEFA Nations League", 0.6),
]
IMPORTANCE_OF_OTHERS = 0.35
#: Decay of a match's weight by day.
DECAY = 0.002

# Quality of leagues.
LEAGUE_FACTORS = {"EPL": 1.00, "La_liga": 0.98, "Bundesliga": 0.97, "Serie_A": 0.94, "Ligue_1": 0.91}

# Columns of a prediction snapshot, its market types, those whose
# probabilities sum to one, and the formats of its fields.
PREDICTION_COLUMNS = ["as_of_date", "match_id", "market_type", "outcome", "p_model", "confidence", "model_version", "notes"]
MARKET_TYPES = ["match_1x2", "outright_winner", "group_winner", "team_advances", "top_scorer", "totals", "btts"]
SUM_TO_ONE = ["match_1x2", "outright_winner", "group_winner", "totals", "btts"]
DAY_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CODE_FORMAT = r"^[A-Z]{3}$"
MATCH_ID_FORMATS = [
    r"^WC26-[A-Z]{3}-[A-Z]{3}-[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^WC26-(R32|R16|QF|SF)-[0-9]{2}$",
    r"^WC26-F$",
    r"^OUTRIGHT-WC2026$",
    r"^GROUP-[A-L]-WC2026$",
    r"^ADVANCE-[A-Z]{3}-WC2026$",
    r"^GOLDENBOOT-WC2026$",
]
TOTALS_FORMAT = r"^(over|under)_[0-9]+(_[0-9]+)?$"
CONFIDENCE_WORDS = ["high", "medium", "low"]
