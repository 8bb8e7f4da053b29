"""The domain rule tables.

Every table here is data the results depend on (labels, patterns, points,
percentages).  Operators take them as defaults; pass your own table to use the
same operator on another domain.
"""

from __future__ import annotations

# --- vocabularies ---------------------------------------------------------------------
PROJECT_TYPES = ["Residential", "Commercial", "Industrial", "Government", "Mixed Use", "Infrastructure"]
STATUS_TYPES = ["Planning", "Proposed", "Approved", "Permitted", "Under Construction", "Completed"]
DIRECT_TRADES = ["Fencing", "Concrete", "HVAC", "Roofing", "Electrical", "Landscaping"]
OPPORTUNITY_TRADES = DIRECT_TRADES + ["Site work", "Security fencing"]
BEHAVIOR_TRADES = [
    "Fencing", "Concrete", "HVAC", "Roofing", "Electrical", "Landscaping", "Site work",
    "Security fencing", "Earthwork", "Utilities", "Residential", "General",
]
EARLY_SIGNALS = ["Land Purchase", "Parcel Split", "Rezoning", "CEQA"]
PIPELINE_SIGNALS = ["Planning Application", "Subdivision Filing", "Environmental Review", "Utility Expansion"]

# --- trades from permit text ----------------------------------------------------------
STRONG_FENCE = [
    r"\b(fence|fencing|chain[-\s]?link|ornamental\s+iron|fence\s+height|pool\s+safety\s+fencing|fencing\s+with\s+gate|gates?/fence|security\s+fence)\b",
    r"\b(new\s*\(?gates?\)?|install(?:ation)?\s+of\s+.{0,40}\bgates?\b|building\s+a\s+.{0,30}\bgate\b|slid(?:e|ing)\s+gates?|automat(?:ic|ed)\s+(?:slide\s+)?gates?|steel\s+gate|security\s+gate|vehicle\s+gate|pedestrian\s+gate|ada\s+ped|ped\s+gates?)\b",
]
PERMIT_A_TRADES = [
    ("Fencing", "|".join(STRONG_FENCE)),
    ("Roofing", r"\b(roof|roofs|roofing|reroof|tpo)\b"),
    ("HVAC", r"\b(hvac|heat\s*pump|mechanical|mech\b|furnace|air\s*handler)\b"),
    ("Electrical", r"\b(electrical|electric|solar|pv\b|battery|panel\s*upgrade)\b"),
    ("Concrete", r"\b(concrete|foundation|footing|stemwall|slab|flatwork)\b"),
    ("Painting", r"\b(paint|painting|stucco\s*paint)\b"),
    ("Carpentry", r"\b(carpenter|carpentry|framing|rough\s*frame|finish\s*carpentry|cabinets?)\b"),
    ("Landscaping", r"\b(landscape|landscaping|irrigation|hardscape)\b"),
    ("Site work", r"\b(grading|site\s*work|utility|utilities|drainage)\b"),
]
PERMIT_B_TRADES = [
    ("Fencing", "|".join(STRONG_FENCE)),
    ("Roofing", r"\b(roof|roofs|roofing|reroof)\b"),
    ("HVAC", r"\b(hvac|mechanical|mech\b|heat\s*pump)\b"),
    ("Electrical", r"\b(electric|electrical|solar|battery|landscape\s+lighting|service\s+pedestal)\b"),
    ("Concrete", r"\b(concrete|foundation|footing|stemwall|slab|flatwork)\b"),
    ("Painting", r"\b(paint|painting)\b"),
    ("Carpentry", r"\b(carpenter|carpentry|framing|cabinets?)\b"),
    ("Landscaping", r"\b(landscape|landscaping|irrigation)\b"),
    ("Site work", r"\b(sewer|grading|site\s*work|utility|utilities)\b"),
]
# Substring variants, one label each (first hit wins).
TRADE_SUBSTRINGS_A = [
    ("Fencing", "fence|wall|gate"), ("Roofing", "roof|tpo"), ("HVAC", "hvac|heat pump|mechanical"),
    ("Electrical", "electrical|solar|pv|battery"), ("Concrete", "concrete|foundation|slab"),
    ("Site work", "grading|site|utility"), ("Fencing", "production home|single-family|subdivision"),
]
TRADE_SUBSTRINGS_B = [
    ("Fencing", "fence|gate|wall"), ("Roofing", "roof"), ("HVAC", "hvac|mechanical"),
    ("Electrical", "electric|solar|battery"), ("Concrete", "concrete|pool|spa"),
    ("Site work", "sewer|grading|site|utility"), ("Fencing", "townhome|residential"),
]
TRADE_SUBSTRINGS_NOTICE = [
    ("Fencing", "fenc"), ("Roofing", "roof"), ("HVAC", "hvac|mechanical"), ("Electrical", "electric"),
    ("Concrete", "concrete"), ("Site work", "site|utility"),
]
REVENUE_SHARES = {
    "Fencing": (0.015, 0.045), "Security fencing": (0.02, 0.06), "Concrete": (0.04, 0.12), "HVAC": (0.08, 0.18),
    "Roofing": (0.12, 0.28), "Electrical": (0.05, 0.16), "Landscaping": (0.02, 0.08), "Site work": (0.05, 0.15),
    "General": (0.02, 0.08),
}
PROJECT_REVENUE_SHARES = {
    "Fencing": (0.015, 0.045), "Concrete": (0.04, 0.12), "Electrical": (0.05, 0.16), "Roofing": (0.1, 0.24),
    "HVAC": (0.08, 0.18), "Landscaping": (0.02, 0.08), "Site work": (0.05, 0.15),
}
HEAVY_FENCE_SHARE = (0.02, 0.06)
OTHER_REVENUE_SHARE = (0.01, 0.04)

# --- planning text --------------------------------------------------------------------
PLANNING_STAGES = [
    ("ceqa", r"\bceqa|eir\b|negative declaration|mitigated negative\b"),
    ("tentative_map", r"\btentative (?:subdivision )?map|final map|parcel map\b"),
    ("design_review", r"\bdesign review|architectural review\b"),
    ("plan_check", r"\bplan check|building plan review\b"),
    ("board_agenda", r"\bplanning commission|board of supervisors|city council|agenda\b"),
    ("pre_application", r"\bpre-?application|preapplication\b"),
    ("entitlement", r"\bentitlement|rezoning|general plan|specific plan|planned development\b"),
]
PLANNING_STAGE_LABELS = {
    "entitlement": "Entitlement", "ceqa": "CEQA / environmental", "tentative_map": "Tentative map / subdivision",
    "plan_check": "Plan check", "design_review": "Design review", "board_agenda": "Board / commission agenda",
    "pre_application": "Pre-application", "unknown": "Planning signal",
}
PLANNING_TRADES = [
    ("Fencing", r"\bfence|fencing|gate|perimeter\b"),
    ("Concrete", r"\bconcrete|foundation|flatwork|sidewalk\b"),
    ("HVAC", r"\bhvac|mechanical\b"),
    ("Electrical", r"\belectrical|solar|lighting\b"),
    ("Landscaping", r"\blandscape|irrigation\b"),
    ("Painting", r"\bpaint|painting\b"),
    ("Carpentry", r"\bframing|carpenter|carpentry\b"),
    ("Site work", r"\bsite work|grading|earthwork|utility|utilities|drainage\b"),
    ("Roofing", r"\broof|roofing\b"),
]
HOUSING_CUE = r"\bsubdivision|master plan|villages?\s+at|production home|single[-\s]?family|multifamily|apartment\b"
HOUSING_STACK = ["Fencing", "Concrete", "Site work", "Landscaping"]
PACKAGE_SMALL = r"\b(short[-\s]?term rental|strp|sign permit|banner|fence height|adu)\b"
PACKAGE_SMALL_UNLESS = r"\bsubdivision|tentative|master plan|specific plan\b"
PACKAGE_HINTS = [
    ("development", r"\b(subdivision|tentative(?:\s+subdivision)?\s+map|large lot|master plan|specific plan|planned development|villages?\s+at|commerce center|industrial park|multifamily|apartment|production home)\b"),
    ("commercial", r"\b(rezone|general plan amendment|community plan|conditional use|design review|commercial|industrial|warehouse)\b"),
]
PLANNING_PROJECT_TYPES = [
    ("industrial", r"\b(industrial|warehouse|commerce center)\b"),
    ("commercial", r"\b(commercial|retail|office|tenant)\b"),
    ("residential", r"\b(subdivision|residential|home|housing|apartment|multifamily|single[-\s]?family)\b"),
    ("infrastructure", r"\b(utility|road|bridge|infrastructure)\b"),
]
PLANNING_NOISE = r"\b(short[-\s]?term rental|str permit|strp|install two non-illuminated|building signs? only)\b"
PLANNING_NOISE_KEEP = r"subdivision|tentative|rezone|specific plan|conditional use|major"
PLANNING_MAJOR = r"major|subdivision|commerce|industrial park|specific plan"

# --- scope text -----------------------------------------------------------------------
PRIMARY_SCOPES = [
    ("Fence / gate installation", r"\b(new\s*\(?gates?\)?|install(?:ation)? of .{0,40}gate|building a .{0,20}gate|automat(?:ic|ed) (?:slide )?gates?|slid(?:e|ing) gates?|steel gate|security gate|raise fence|new fence|pool safety fencing|security fence|gates/fence|fence height|fencing with gate|chain[-\s]?link fence|ada ped|ped gates?)\b", 92),
    ("Electrical / landscape lighting", r"\b(electrical for landscaping|commercial electrical service|electrical service pedestal|landscape lighting|service pedestal|electrical service)\b|\belectrical\b.{0,40}\blandscap|\blandscap.{0,40}\belectrical", 90),
    ("Solar / electrical", r"\b(solar|photovoltaic|\bpv\b|energy storage|powerwall|battery)\b", 88),
    ("HVAC / mechanical", r"\b(hvac|heat pump|package unit|mechanical|air conditioning)\b", 86),
    ("Roofing", r"\b(reroof|roof replacement|tpo|membrane|capsheet|re-roof)\b", 86),
    ("Drainage / water infrastructure", r"\b(creek|drainage|stormwater|hydrology|culvert|channel|water quality)\b", 84),
    ("Interior remodel / TI", r"\b(interior remodel|tenant improvement|kitchen|bathroom|flooring)\b", 82),
    ("School construction", r"\b(school|campus|classroom)\b", 80),
    ("Parks / recreation", r"\b(park|trail|open space|sports field|recreation)\b", 78),
    ("Residential development", r"\b(subdivision|village|production home|master plan|sfd|residential lots?)\b", 70),
    ("Industrial site work", r"\b(industrial|warehouse|\byard\b|manufacturing)\b", 70),
]
FENCE_SCOPE = "Fence / gate installation"
PROJECT_CATEGORIES = [
    ("Housing", r"housing|homes|residential|subdivision|village|lot|unit|master plan|apartment|single family|sfd"),
    ("Commercial", r"commercial|tenant|retail|office|shopping|restaurant"),
    ("Industrial", r"\bindustrial\b|\bwarehouse\b|\byard\b|manufacturing"),
    ("Utilities", r"utility|utilities|sewer|water|storm|drainage|solar|pv|energy storage|power"),
    ("Public Works", r"public works|city|county|public|bid|procurement"),
    ("Roads", r"road|street|curb|gutter|sidewalk|driveway|paving|asphalt"),
    ("Schools", r"school|campus|classroom"),
    ("Parks", r"park|playground|trail|open space|recreation"),
    ("Environmental", r"creek|environmental|restoration|wetland|habitat|ceqa"),
    ("Drainage", r"drainage|storm|creek|trunk|channel|culvert"),
    ("Trails", r"trail|path|bike|pedestrian"),
    ("Security", r"security fence|access control|perimeter fence|security gate"),
    ("Infrastructure", r"infrastructure|site work|earthwork|grading|utility relocation|development infrastructure"),
]
WORK_CATEGORIES = [
    ("Earthwork", r"earthwork|grading|excavat"),
    ("Drainage improvements", r"drainage|storm|creek|culvert"),
    ("Utility work", r"utility|sewer|water|power|solar"),
    ("Site access improvements", r"site work|access|road|paving|curb|sidewalk"),
    ("Residential development infrastructure", r"subdivision|homes|residential|lot|village"),
    ("Roofing", r"roof|tpo|membrane|reroof"),
    ("Mechanical", r"hvac|mechanical|package unit"),
    ("Demolition", r"demo|demolition"),
]
PRIMARY_WORK = [
    ("Drainage / water infrastructure", r"creek|drainage|stormwater|hydrology|water quality|culvert|channel"),
    ("Earthwork", r"earthwork|grading|excavat"),
    ("Solar / electrical", r"solar|photovoltaic|pv|energy storage"),
    ("Roofing", r"roof|reroof|tpo|membrane|capsheet"),
    ("HVAC / mechanical", r"hvac|mechanical|package unit|air conditioning"),
    ("Interior remodel", r"interior remodel|kitchen|bathroom|flooring|painting|tenant improvement"),
    ("Residential development", r"subdivision|village|residential|homes|apartment|lots?"),
    ("School construction", r"school|campus"),
    ("Parks / public recreation", r"park|trail|open space|recreation|sports field"),
    ("Industrial site work", r"industrial|warehouse|yard"),
]
SCOPE_PROJECT_TYPES = [
    ("Creek Realignment", r"creek.*re[-\s]?align|re[-\s]?align.*creek"),
    ("Subdivision", r"subdivision|village|lots?"),
    ("School", r"school|campus"),
    ("Parks / Recreation", r"park|trail|open space|sports field"),
    ("Solar Retrofit", r"solar|photovoltaic|pv"),
    ("Building Addition / Remodel", r"addition|remodel"),
    ("Roof Replacement", r"roof|reroof"),
    ("Utility / Infrastructure", r"utility|pipeline|drainage|stormwater"),
]
LIKELY_TRADE_GROUPS = [
    (["Excavation", "Civil", "Drainage", "Environmental"], r"earthwork|grading|excavat|creek|drainage|stormwater|hydrology|culvert|channel"),
    (["Site work", "Utility", "Concrete"], r"subdivision|site work|utility|road|curb|sidewalk"),
    (["Electrical"], r"solar|photovoltaic|pv|electrical|power"),
    (["Roofing"], r"roof|reroof|tpo|membrane"),
    (["HVAC"], r"hvac|mechanical|package unit"),
]
FENCE_INSTALL_LANGUAGE = r"install(?:ation)? of .{0,40}(?:fence|gate)|new fence|raise fence|build(?:ing)? a .{0,20}(?:fence|gate)|chain[-\s]?link|ornamental iron|pool safety fenc|security fence|gates/fence|fence height|new gates|sliding gate|automatic gate|steel gate|vehicle gate|pedestrian gate|security gate|detention basin[^.]{0,80}fenc|fenc[^.]{0,80}detention basin"
DIRECT_WORK = r"earthwork|grading|excavat|creek|drainage|stormwater|hydrology|culvert|solar|photovoltaic|roof|hvac|subdivision|school|park|fence|fencing|gate"
FENCE_STRONG = [
    ("Install/raise/new/build fence", r"install(?:ation)? of .{0,40}fence|new fence|raise fence|build(?:ing)? a .{0,20}fence|supply and install.{0,60}fenc"),
    ("Fence height specification", r"fence height"),
    ("Pool safety fencing", r"pool safety fenc"),
    ("Security fence", r"\bsecurity fence\b"),
    ("Gates and fence combined", r"gates/fence|gate.{0,20}fence|fenc(?:e|es|ing).{0,30}gate"),
    ("Chain link fencing", r"chain[-\s]?link"),
    ("Ornamental iron fencing", r"ornamental iron"),
    ("New gates installation", r"new\s*\(?gates?\)?|install(?:ation)? of .{0,40}gate|building a .{0,20}gate|supply and install.{0,60}gate"),
    ("Sliding or automatic gate", r"slid(?:e|ing) gates?|automat(?:ic|ed) (?:slide )?gates?"),
    ("Steel vehicle or pedestrian gate", r"steel gate|vehicle gate|pedestrian gate|\bped gates?\b|ada ped"),
    ("Security gate", r"\bsecurity gate\b"),
    ("Detention basin fencing", r"detention basin[^.]{0,80}\bfenc(?:e|ing)?\b|\bfenc(?:e|ing)?\b[^.]{0,80}detention basin"),
    ("Park trail or school fencing", r"park fencing|trail fencing|school fencing|sports field fencing|dog park fencing"),
]
FENCE_WEAK = [
    ("Gate reference (bare)", r"\bgates?\b"),
    ("Screen wall or enclosure", r"screen wall|\benclosure\b"),
    ("Perimeter fence mention", r"perimeter fence|perimeter fencing|community perimeter"),
    ("Fence reference (bare)", r"\bfenc(?:e|es|ing)\b"),
]
FENCE_CONTEXT = [
    ("Subdivision or community development evidence", r"subdivision|residential|homes|village|lots?|apartment"),
    ("School, park, trail, or sports facility evidence", r"school|campus|park|trail|open space|sports field|recreation"),
    ("Industrial yard or security-sensitive site evidence", r"industrial|warehouse|yard|security"),
]
FENCE_NEGATIVE = [
    ("Primary work is electrical / landscape lighting", r"electrical for landscaping|landscape lighting|service pedestal|electrical service pedestal|commercial electrical service"),
    ("Electrical service is primary work", r"\belectrical\b.{0,40}\blandscap|\blandscap.{0,40}\belectrical|electrical upgrade|electrical service\b"),
    ("Solar or photovoltaic work is primary", r"\b(solar|photovoltaic|\bpv\b|energy storage)\b"),
    ("Creek restoration or drainage is primary work", r"creek restoration|creek|water quality|drainage|stormwater|hydrology"),
    ("Pipeline or utility work is primary work", r"pipeline|utility relocation|water main|sewer|trunk"),
    ("Interior remodel only", r"interior remodel|kitchen|living room|bathroom|flooring|tenant improvement"),
    ("Roofing-only work", r"roof replacement|reroof|tpo|membrane|capsheet"),
    ("Painting or finish work", r"\bpainting\b|\bpaint\b"),
    ("HVAC-only work", r"hvac|package unit|air conditioning"),
    ("Minor repair or single-trade renovation", r"\bminor\b|\brepair\b|like for like|\bsiding\b"),
    ("Tiny demolition or accessory structure", r"demo \(shed\)|accessory structure|detached garage|patio cover"),
]
FENCE_BONUS_CATEGORIES = ["Schools", "Parks", "Industrial", "Housing"]
ASSOCIATED_IMPROVEMENTS = [
    ("Roads / site access", r"road|street|access"), ("Utilities", r"utility|sewer|water|power"),
    ("Drainage", r"drainage|storm|creek|trunk"), ("Parks / trails", r"park|trail|open space"),
    ("Site development", r"site work|earthwork|grading"),
]
PRIMARY_OBJECTIVES = [
    ("Enable drainage, utility, or site infrastructure improvements.", r"drainage|creek|storm|trunk"),
    ("Enable future residential construction.", r"residential|homes|subdivision|village"),
    ("Support public access or recreation improvements.", r"park|trail|open space"),
]
VETO_SCOPES = [
    "Electrical / landscape lighting", "Solar / electrical", "HVAC / mechanical", "Roofing",
    "Drainage / water infrastructure", "Interior remodel / TI",
]
CONFIDENCE_RENAMES = {
    "Primary Scope": "Primary Opportunity", "Secondary Scope": "Secondary Opportunity", "Possible Scope": "Possible Opportunity",
    "Weak Signal": "Weak Opportunity", "No Meaningful Fence Opportunity": "No Evidence",
}

# --- trade models ---------------------------------------------------------------------
TRADE_MODELS = {
    "Fencing": dict(
        terms=["fence", "fencing", "gate", "gates", "chain link", "perimeter", "security fence", "access control"],
        adjacent=["subdivision", "school", "park", "utility", "commercial", "industrial", "apartment", "site work", "drainage", "public works"],
        saturation=["fence", "fencing", "gate", "gates", "entry controls", "access control"]),
    "Concrete": dict(
        terms=["concrete", "slab", "foundation", "footing", "stemwall", "sidewalk", "curb", "gutter", "flatwork", "driveway"],
        adjacent=["subdivision", "commercial", "industrial", "school", "park", "utility", "site work"],
        saturation=["concrete", "cement", "flatwork"]),
    "Painting": dict(
        terms=["paint", "painting", "painter", "coating", "stain"],
        adjacent=["commercial", "apartment", "school", "tenant improvement", "residential"],
        saturation=["paint", "painting", "painter"]),
    "Carpentry": dict(
        terms=["carpenter", "carpentry", "framing", "rough frame", "finish carpentry", "cabinets", "millwork", "trim"],
        adjacent=["residential", "commercial", "apartment", "tenant improvement", "addition"],
        saturation=["carpenter", "carpentry", "framing", "cabinets"]),
    "Roofing": dict(
        terms=["roof", "roofing", "reroof", "tpo", "membrane", "capsheet", "shingle"],
        adjacent=["commercial", "school", "industrial", "apartment", "tenant improvement"],
        saturation=["roof", "roofing"]),
    "Electrical": dict(
        terms=["electrical", "electric", "solar", "pv", "service panel", "lighting", "power"],
        adjacent=["commercial", "industrial", "school", "utility", "subdivision", "tenant improvement"],
        saturation=["electrical", "electric", "solar"]),
    "Plumbing": dict(
        terms=["plumbing", "sewer", "water", "gas line", "backflow", "drain"],
        adjacent=["commercial", "school", "apartment", "subdivision", "utility", "tenant improvement"],
        saturation=["plumbing", "plumber"]),
    "HVAC": dict(
        terms=["hvac", "mechanical", "package unit", "rtu", "air conditioning", "heat pump"],
        adjacent=["commercial", "school", "industrial", "tenant improvement", "apartment"],
        saturation=["hvac", "mechanical", "heating", "air"]),
    "Landscaping": dict(
        terms=["landscape", "landscaping", "irrigation", "planting", "turf"],
        adjacent=["subdivision", "park", "school", "commercial", "apartment"],
        saturation=["landscape", "landscaping", "irrigation"]),
    "Demolition": dict(
        terms=["demo", "demolition", "remove", "removal"],
        adjacent=["commercial", "industrial", "school", "public works", "redevelopment"],
        saturation=["demo", "demolition", "wrecking"]),
    "Utility": dict(
        terms=["utility", "utilities", "drainage", "sewer", "water main", "storm", "trunk"],
        adjacent=["subdivision", "public works", "infrastructure", "commercial", "industrial"],
        saturation=["utility", "utilities", "underground", "engineering"]),
    "Site work": dict(
        terms=["site work", "grading", "earthwork", "drainage", "paving", "utility", "excavation"],
        adjacent=["subdivision", "commercial", "industrial", "school", "park", "public works"],
        saturation=["site work", "grading", "earthwork", "excavating", "engineering"]),
    "Solar": dict(
        terms=["solar", "pv", "photovoltaic", "energy storage", "battery"],
        adjacent=["commercial", "school", "industrial", "subdivision", "utility"],
        saturation=["solar", "renewable", "energy"]),
    "Security": dict(
        terms=["security", "access control", "camera", "alarm", "perimeter", "gate"],
        adjacent=["commercial", "industrial", "school", "public works", "apartment"],
        saturation=["security", "access control", "alarm", "entry controls"]),
    "Asphalt": dict(
        terms=["asphalt", "paving", "parking lot", "road", "driveway"],
        adjacent=["commercial", "industrial", "school", "park", "public works", "subdivision"],
        saturation=["asphalt", "paving"]),
    "General Contractor": dict(
        terms=["general contractor", "construction", "building", "tenant improvement", "remodel", "addition"],
        adjacent=["commercial", "industrial", "school", "apartment", "public works"],
        saturation=["general contractor", "builders", "construction"]),
}
ADJACENT_CAPPED_TRADES = [
    "Fencing", "Concrete", "Electrical", "Plumbing", "HVAC", "Landscaping", "Painting", "Carpentry", "Security", "Asphalt",
]
TRADE_EVIDENCE_TERMS = {
    "Fencing": ["fence", "fencing", "chain link", "perimeter fence", "security fence", "new (gates", "sliding gate", "steel gate", "vehicle gate", "pedestrian gate"],
    "Concrete": ["concrete", "slab", "foundation", "footing", "stemwall", "sidewalk", "curb", "gutter", "flatwork", "driveway"],
    "Painting": ["paint", "painting", "painter", "coating", "stain"],
    "Carpentry": ["carpenter", "carpentry", "framing", "rough frame", "finish carpentry", "cabinets", "millwork", "trim"],
    "Roofing": ["roofing", "reroof", "re-roof", "tpo", "membrane", "capsheet", "shingle", "roof geometry", "update roof"],
    "Electrical": ["electrical", "electrician", "electric", "solar", "photovoltaic", "pv ", "pv+", "service panel", "lighting", "panel upgrade"],
    "Plumbing": ["plumbing", "plumber", "sewer", "water line", "gas line", "backflow"],
    "HVAC": ["hvac", "package unit", "package units", "rtu", "air conditioning", "heat pump", "mech (", "mech(", "mechanical system", "mechanical equipment", "rooftop packaged", "split system"],
    "Landscaping": ["landscape", "landscaping", "irrigation", "planting", "turf"],
    "Demolition": ["demo", "demolition", "wrecking"],
    "Utility": ["utility", "utilities", "drainage", "sewer", "water main", "storm"],
    "Site work": ["site work", "grading", "earthwork", "excavation", "paving"],
    "Solar": ["solar", "photovoltaic", "pv ", "energy storage", "battery"],
    "Security": ["security", "access control", "camera", "alarm"],
    "Asphalt": ["asphalt", "paving", "parking lot"],
    "General Contractor": ["general contractor", "tenant improvement", "remodel", "addition"],
}
BOILERPLATE = r"no additional[^.]{0,80}(electrical|mechanical|plumbing|structural)[^.]{0,80}"
DOCUMENT_TRADE_TERMS = {
    "Fencing": ["fence", "fencing", "gate", "chain link", "perimeter"],
    "Concrete": ["concrete", "stemwall", "stem wall", "foundation", "footing", "flatwork", "slab", "driveway", "sidewalk"],
    "Roofing": ["roof", "roofing", "reroof", "re-roof", "shingle", "membrane"],
    "HVAC": ["hvac", "heat pump", "package unit", "rtu", "mechanical"],
    "Electrical": ["electrical", "solar", "panel", "photovoltaic"],
    "Plumbing": ["plumbing", "repipe", "sewer", "water line"],
}
SCOPE_SIZE_LARGE = r"(subdivision|village|unit \d|phase|school|park|utility|trunk|drainage|public works|industrial|warehouse|apartment|commercial|shopping|corridor|infrastructure|master plan)"
SCOPE_SIZE_MAJOR = r"trunk|infrastructure|subdivision|master plan|utility|school|industrial"
SCOPE_SIZE_SMALL = r"(tenant improvement|ti |addition|remodel|new home|single family|adu|detached garage|reroof|roof top package|package unit)"
SCOPE_SIZE_TINY = r"(shed|repair|replace|like for like|minor|backyard|deck|patio cover|gate replacement|demo \(shed\)|accessory structure)"
SUBCONTRACT_MEDIUM = r"(public works|bid|trade partner|vendor|commercial|industrial|school|apartment)"
SUBCONTRACT_LOW = r"(homeowner|single family|minor|repair|replace|shed|like for like|detached garage|deck|patio)"
SIZE_MEDIUM = r"(commercial|industrial|school|public works|apartment)"
STAGE_OPEN = r"(planning|pre-construction|bid|permitting|application|review|issued)"
STAGE_LATE = r"(completed|closed|finalized|expired|final)"
GENERAL_CONTRACTOR_NAMES = r"(construction|builders|general engineering|development)"
TRADE_NOISE = {
    "Fencing": [r"(demo \(shed\)|shed demolition|small shed|single gate|gate replacement|deck rail replacement)", r"(solar|photovoltaic|energy storage)"],
    "Demolition": [r"(shed|deck demo|interior demo).{0,30}(residential|single family|house)?"],
}
FENCE_ELECTRICAL_NOISE = r"(electrical for landscaping|commercial electrical service|electrical service pedestal|landscape lighting|service pedestal)"
FENCE_ELECTRICAL_NOISE_UNLESS = r"\b(new\s*\(?gates?|install(?:ation)? of .{0,40}gate|sliding gate|automatic gate|steel gate|security gate|fence|fencing)\b"

# --- search ---------------------------------------------------------------------------
SEARCH_TRADE_ALIASES = {
    "fence": ["Fencing"], "fencing": ["Fencing"], "gate": ["Fencing", "Security"], "gates": ["Fencing", "Security"],
    "concrete": ["Concrete"], "footing": ["Concrete"], "footings": ["Concrete"],
    "paint": ["Painting"], "painting": ["Painting"], "painter": ["Painting"], "painters": ["Painting"],
    "carpenter": ["Carpentry"], "carpenters": ["Carpentry"], "carpentry": ["Carpentry"], "framing": ["Carpentry"],
    "roofer": ["Roofing"], "roofers": ["Roofing"], "roofing": ["Roofing"], "roof": ["Roofing"],
    "electrician": ["Electrical"], "electricians": ["Electrical"], "electrical": ["Electrical"],
    "plumber": ["Plumbing"], "plumbers": ["Plumbing"], "plumbing": ["Plumbing"],
    "hvac": ["HVAC"], "mechanical": ["HVAC"],
    "landscaper": ["Landscaping"], "landscapers": ["Landscaping"], "landscaping": ["Landscaping"],
    "demolition": ["Demolition"], "demo": ["Demolition"],
    "utility": ["Utility", "Site work"], "utilities": ["Utility", "Site work"],
    "sitework": ["Site work"], "site work": ["Site work"], "solar": ["Solar", "Electrical"], "security": ["Security"],
    "asphalt": ["Asphalt"], "paving": ["Asphalt", "Site work"], "gc": ["General Contractor"],
    "contractor": [], "contractors": [],
}
KEYWORD_SYNONYMS = {
    "apartments": ["mixed use", "residential", "units", "homes"],
    "subdivision": ["subdivision", "subdivisions", "residential", "filing"],
    "subdivisions": ["subdivision", "residential", "filing"],
    "fence": ["fence", "fencing", "subdivision", "industrial", "utility", "utilities", "perimeter", "security", "chain link", "gate", "parks", "schools", "site work"],
    "fencing": ["fence", "fencing", "subdivision", "industrial", "utility", "utilities", "perimeter", "warehouse", "security", "gate", "chain link", "parks", "schools", "site work"],
    "commercial": ["commercial", "tenant", "business", "retail", "warehouse"],
    "industrial": ["industrial", "warehouse", "logistics", "outdoor", "storage", "utility"],
    "hvac": ["mechanical", "commercial", "government"],
    "warehouse": ["warehouse", "industrial", "logistics", "fencing", "site work"],
    "land": ["land purchase", "parcel", "rezoning"],
    "purchases": ["land purchase"],
    "approved": ["approved"],
    "active": ["permitted", "under construction", "planning application"],
    "opportunity": ["permit", "planning application", "subdivision filing", "approved"],
    "opportunities": ["permit", "planning application", "subdivision filing", "approved"],
    "jobs": ["permit", "approved", "permitted", "under construction"],
    "work": ["permit", "approved", "permitted", "under construction"],
    "bids": ["government", "public works", "infrastructure"],
    "bid": ["government", "public works", "infrastructure"],
    "parks": ["public works", "bid", "vendor", "fencing", "perimeter"],
    "park": ["public works", "bid", "vendor", "fencing", "perimeter"],
    "schools": ["public works", "bid", "vendor", "fencing", "perimeter"],
    "school": ["public works", "bid", "vendor", "fencing", "perimeter"],
    "perimeter": ["fencing", "security", "gate", "chain link"],
    "security": ["fencing", "perimeter", "gate", "chain link"],
    "utilities": ["utility", "drainage", "infrastructure", "site work", "fencing"],
    "utility": ["utilities", "drainage", "infrastructure", "site work", "fencing"],
    "sam": ["government", "public works", "infrastructure"],
    "months": ["permitted", "approved"],
    "six": ["permitted", "approved"],
    "90": ["permitted", "issued", "fast money"],
    "days": ["permitted", "issued", "fast money"],
    "fast": ["permitted", "issued", "under construction"],
    "money": ["permitted", "issued", "under construction"],
    "roseville": ["roseville", "placer"],
    "rocklin": ["rocklin", "placer"],
}
ACCESS_SYNONYMS = {
    "fence": ["fencing", "gate", "chain link", "perimeter", "security", "subdivision", "site work", "utility"],
    "fencing": ["fence", "gate", "chain link", "perimeter", "security", "subdivision", "site work", "utility"],
    "jobs": ["opportunity", "work", "permit", "planning", "bid"],
    "job": ["opportunity", "work", "permit", "planning", "bid"],
    "sacramento": ["sacramento", "south sacramento", "natomas"],
    "subdivision": ["subdivision", "residential", "homes", "village", "lot"],
    "subdivisions": ["subdivision", "residential", "homes", "village", "lot"],
    "school": ["school", "public works", "bid", "vendor"],
    "schools": ["school", "public works", "bid", "vendor"],
    "park": ["park", "public works", "bid", "vendor"],
    "parks": ["park", "public works", "bid", "vendor"],
    "utility": ["utility", "utilities", "drainage", "infrastructure", "site work"],
    "utilities": ["utility", "utilities", "drainage", "infrastructure", "site work"],
    "commercial": ["commercial", "tenant", "industrial", "warehouse"],
    "development": ["developer", "subdivision", "planning", "residential"],
    "developments": ["developer", "subdivision", "planning", "residential"],
}
CSI_DIVISIONS = {
    "Concrete": ["03 - Concrete"], "Carpentry": ["06 - Wood, Plastics, Composites"], "Painting": ["09 - Finishes"],
    "Roofing": ["07 - Thermal & Moisture Protection"], "Plumbing": ["22 - Plumbing"], "HVAC": ["23 - HVAC"],
    "Electrical": ["26 - Electrical"], "Solar": ["26 - Electrical", "48 - Electrical Power Generation"],
    "Landscaping": ["32 - Exterior Improvements"], "Fencing": ["32 - Exterior Improvements"],
    "Asphalt": ["32 - Exterior Improvements"], "Site work": ["31 - Earthwork", "32 - Exterior Improvements"],
    "Utility": ["33 - Utilities"], "Demolition": ["02 - Existing Conditions"],
    "Security": ["28 - Electronic Safety & Security"], "General Contractor": ["01 - General Requirements"],
}
FACET_LABELS = {
    "development": "Development / Large", "commercial": "Commercial package", "small": "Small / residential",
    "phone": "Has phone", "research": "Research only",
    "subdivision": "Subdivision / housing", "commercial_package": "Commercial / trade package",
    "public_site": "Public / site", "side_scope": "Side-scope add-on",
}
FACET_VALUES = {
    "size": ["development", "commercial", "small"],
    "contact": ["phone", "research"],
    "type": ["subdivision", "commercial_package", "public_site", "side_scope"],
}
FENCE_SCOPE_RANKS = {
    "Primary Opportunity": 5, "Primary Scope": 5, "Secondary Opportunity": 4, "Secondary Scope": 4,
    "Possible Opportunity": 3, "Possible Scope": 3, "Weak Opportunity": 1, "Weak Signal": 1,
    "No Evidence": 0, "No Meaningful Fence Opportunity": 0,
}
WEAK_FENCE_SCOPES = ["Weak Opportunity", "Weak Signal", "No Evidence", "No Meaningful Fence Opportunity"]
STRONG_FENCE_SCOPES = [
    "Primary Opportunity", "Primary Scope", "Secondary Opportunity", "Secondary Scope", "Possible Opportunity", "Possible Scope",
]
POSITIVE_FENCE = r"\b(perimeter fencing|boundary fencing|security fencing|access control|gate systems?|detention basin fencing|trail fencing|park fencing|school fencing|enclosure requirements?|wall/fence|wall and fence|fence package|fencing package|subdivision perimeter|hoa fencing|screening requirements?|fencing|fence|gates?|enclosure|screening)\b"
POSITIVE_FENCE_STRONG = r"\b(fence installation|fence package|chain-link|chain link|ornamental|wrought|gate installation|slid(?:e|ing) gates?|automat(?:ic|ed)|steel gate|security gate|vehicle gate|pedestrian gate|ada ped|ped gates?|detention basin fencing|park fencing|school fencing|trail fencing|sports field fencing|new fence|raise fence|pool safety|security fence|gates/fence|fencing with|direct fence|new gates|install/raise|chain link fencing)\b"
INCIDENTAL_FENCE = r"incidental|weak mention|enclosure or screen"
PRODUCTION_BUILDERS = r"\b(lennar|kb home|taylor morrison|meritage|dr horton|d\.?r\.? horton|pulte|century communities|tri pointe|shea homes|richmond american|toll brothers|elliott homes|woodside homes|beazer)\b"
SUBDIVISION_CUES = r"\b(villages?\s+at|unit\s+\d+|lot\s+\d+|subdivision|subdivisions|master\s*plan|production\s+housing|planned\s+development|tract\s+\d+|lakelet|northlake|sfd)\b"
HOUSING_NAMES = r"\b(housing|residential development|single[-\s]?family|duplex|townhome|apartment|multifamily|community|homes?\b)\b"
NOT_HOUSING_NAMES = r"\b(drainage|trunk|sewer|water\s+main|credit\s+agreement|fee\s+credit|assessment\s+district)\b"
PACKAGE_CUES = r"\b(perimeter|subdivision|detention basin|park fencing|school fencing|trail fencing|chain[-\s]?link|security fencing|security fence|fence package|fencing package)\b"
LONG_RUN = r"\b(\d{1,3}(?:,\d{3})+|\d{4,})\s*(?:lf|linear\s*feet|lin(?:ear)?\.?\s*ft\.?)\b"
NON_FENCE_PERMIT = [r"^\s*(solar|mech\b|hvac|pv\b|plumbing|electrical)\b", r"\bsolar\s*:", r"\bmech\s*\(", r"\bhvac\s*c/?o\b"]
TINY_KEEP = r"\b(perimeter|subdivision|detention|park fencing|school fencing|chain[-\s]?link fence|security fencing|fence package)\b"
TINY_RESIDENTIAL = [
    r"\b(raise\s+(?:existing\s+)?fence|re-?build(?:ing)?\s+the\s+front\s+section\s+of\s+my\s+fence|front\s+section\s+of\s+my\s+fence|side\s+yard|my\s+fence)\b",
    r"\b(swimming\s+pool|pool\s+remodel|pool\s+safety\s+fencing)\b",
]
SIDE_SCOPE_PRIMARY = r"\b(new\s*\(?gates?/?fence|new\s*\(?gates?\)?|install(?:ation)?\s+of\s+electric\s+sliding\s+gate|security\s+fence|chain[-\s]?link\s+fence|fence\s+package|raise\s+fence|new\s+fence)\b"
SIDE_SCOPE_PRIMARY_NAME = r"^[^:]*\b(fence|gates?)\b"
SIDE_SCOPE_NAME = r"\b(swimming\s+pool|pool\s+remodel|pouring\s+driveway|tenant\s+improvement|interior\s+remodel|kitchen|bath\s+remodel)\b"
SIDE_SCOPE = r"\b(swimming\s+pool|pool\s+remodel|pouring\s+driveway|driveway\s+over\s+culvert|tenant\s+improvement|interior\s+remodel|kitchen-bath|hvac\s*c/?o|mech\s*\()\b"
PUBLIC_SITE = r"\b(public\s+works|school\s+fencing|park\s+fencing|trail\s+fencing|detention\s+basin|municipal\s+(?:project|site|facility)|cell\s+tower)\b"
COMMERCIAL_TEXT = r"\b(commercial|industrial|warehouse|school|public works|tenant improvement|apartment)\b"

# --- roles, paths, relations ----------------------------------------------------------
ROLE_KEY_PATTERNS = [
    ("Developer", r"developer|builder"), ("Property Owner", r"owner|property.?owner"), ("Applicant", r"applicant"),
    ("General Contractor", r"contractor|general.?contractor"), ("Architect", r"architect"), ("Engineer", r"engineer"),
]
ROLE_FROM_TEXT = [
    ("Developer", "developer|builder"), ("Property Owner", "owner"), ("Applicant", "applicant"),
    ("Architect", "architect"), ("Engineer", "engineer"),
]
TARGET_CONTACT_ROLES = [
    "Owner", "President", "CEO", "Development Director", "Construction Director", "Project Executive",
    "Project Manager", "Procurement Contact", "Estimator",
]
EXTRACTION_TYPES = [
    ("developer", "developer"), ("general_contractor", "general contractor"), ("architect", "architect"), ("engineer", "engineer"),
    ("property_owner", "owner"), ("construction_manager", "construction manager"), ("project_manager", "project manager"),
]
PATH_VALUE_RANK = {"High": 3, "Medium": 2, "Low": 1}
REGISTRATION_PATHS = ["vendor_registration", "subcontractor_registration"]
BID_PATHS = ["bid_portal", "public_procurement", "plan_room"]
TYPICAL_OPPORTUNITY = {
    "Developer": "Subdivision Trades", "General Contractor": "Subcontracted Trade Packages",
    "Architect": "Design-Led Project Intelligence", "Engineer": "Infrastructure and Site Work",
    "Property Owner": "Owner-Directed Procurement",
}
ORG_RELATIONS = [
    "developer_gc", "developer_architect", "developer_engineer", "developer_property_owner", "gc_trade_contractor", "developer_trade_contractor",
]

# --- document extraction --------------------------------------------------------------
# (type, category, label, pattern)
SCOPE_ITEMS = [
    ("chain_link_fence", "Fencing", "Chain link fence", r"chain[-\s]?link(?:\s+fence|\s+fencing)?"),
    ("wood_fence", "Fencing", "Wood fence", r"wood(?:en)?\s+fence|cedar\s+fence"),
    ("vinyl_fence", "Fencing", "Vinyl fence", r"vinyl\s+fence"),
    ("security_fence", "Fencing", "Security fence", r"security\s+fence|perimeter\s+security"),
    ("perimeter_fence", "Fencing", "Perimeter fence", r"perimeter\s+fenc(?:e|ing)"),
    ("construction_fence", "Fencing", "Temporary construction fence", r"temporary\s+(?:construction\s+)?fenc(?:e|ing)|construction\s+fenc(?:e|ing)"),
    ("gate", "Gates", "Gate", r"\b(?:sliding|vehicle|pedestrian|automatic|steel|security)\s+gates?\b|\bgate\s+systems?\b|\bfence(?:ing)?\s+and\s+gates?\b"),
    ("foundation", "Foundation", "Foundation", r"\bfoundations?\b|\bfootings?\b"),
    ("stemwall", "Foundation", "Stemwall", r"stem\s*-?\s*walls?"),
    ("slab", "Slab", "Slab", r"concrete\s+slabs?|\bslab\s+on\s+grade\b|\bfloor\s+slabs?\b"),
    ("flatwork", "Flatwork", "Flatwork", r"\bflatwork\b|sidewalks?|curb(?:s|ing)?(?:\s+and\s+gutter)"),
    ("driveway", "Driveways", "Driveway", r"\bdriveways?\b"),
    ("retaining_wall", "Retaining Walls", "Retaining wall", r"retaining\s+walls?"),
    ("reroof", "Roofing", "Re-roof", r"\bre-?roofs?\b|roof\s+replacement|new\s+roof|\broofing\b"),
    ("hvac", "HVAC", "HVAC", r"\bhvac\b|heat\s+pumps?|package\s+units?|\brtu\b|split\s+system"),
    ("electrical", "Electrical", "Electrical", r"\belectrical\b|service\s+panel|solar|photovoltaic|\bpv\b"),
    ("plumbing", "Plumbing", "Plumbing", r"\bplumbing\b|repipe|backflow|gas\s+line"),
    ("water", "Utilities", "Water", r"water\s+(?:main|line|service)|domestic\s+water"),
    ("sewer", "Utilities", "Sewer", r"\bsewer\b|sanitary\s+sewer"),
    ("storm_drain", "Utilities", "Storm drain", r"storm\s+drain|stormwater|drainage"),
    ("site_work", "Site Prep", "Site work", r"site\s+work|grading|earthwork|excavation"),
    ("demolition", "Demolition", "Demolition", r"\bdemolition\b|\bdemo\b"),
]
NUMBER = r"(?:\d{1,3}(?:,\d{3})*|\d+(?:\.\d+)?)"
QUANTITIES = [
    ("linear_feet", NUMBER + r"\s*(?:linear\s*feet|lin(?:ear)?\.?\s*ft\.?|\bLF\b)"),
    ("square_feet", NUMBER + r"\s*(?:square\s*feet|sq\.?\s*ft\.?|\bSF\b)"),
    ("cubic_yards", NUMBER + r"\s*(?:cubic\s*yards?|cu\.?\s*yds?\.?|\bCY\b)"),
]
NEARBY_QUANTITY = NUMBER + r"\s*(?:linear\s*feet|lin(?:ear)?\.?\s*ft\.?|\bLF\b|square\s*feet|sq\.?\s*ft\.?|\bSF\b)"
QUANTITY_CONTEXT = r"fence|wall|sidewalk|driveway|slab|roof|pipe"
DATE_TEXT = r"[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"
QUARTER_TEXT = DATE_TEXT + r"|Q[1-4]\s+\d{4}"
TIMELINE = [
    ("bid_due", "Bid Due", rf"bid\s+(?:due|date|deadline|opening)[:\s-]+({DATE_TEXT})"),
    ("hearing_date", "Hearing Date", rf"(?:planning\s+)?(?:commission\s+)?hearing(?:\s+date)?[:\s-]+({DATE_TEXT})"),
    ("approval_date", "Planning Approval", rf"(?:approved|approval(?:\s+date)?)[:\s-]+({DATE_TEXT})"),
    ("construction_start", "Construction Start", rf"(?:construction\s+start|start\s+of\s+construction|commence(?:ment)?)[:\s-]+({QUARTER_TEXT})"),
    ("construction_completion", "Expected Completion", rf"(?:completion|complete(?:d)? by|finish(?:ed)? by)[:\s-]+({QUARTER_TEXT})"),
    ("permit_issued", "Permit Issued", rf"permit\s+issued[:\s-]+({DATE_TEXT})"),
]
PROCUREMENT_PATHS = [
    ("Public Bid", r"\bpublic\s+bid\b|\binvite(?:d)?\s+bid|\bbid\s+opening\b|\bsealed\s+bid\b"),
    ("RFP", r"\brequest\s+for\s+proposal\b|\bRFP\b"),
    ("RFQ", r"\brequest\s+for\s+qualifications?\b|\bRFQ\b"),
    ("Design-Build", r"\bdesign[-\s]?build\b"),
    ("GC Relationship", r"\bgeneral\s+contractor\b|\bGC\b|\bsubcontractor\b|\btrade\s+partner\b"),
    ("Developer Direct", r"\bdeveloper\b|\bbuilder\b|\bowner[-\s]?builder\b"),
    ("Subcontract Opportunity", r"\bsubcontract(?:or|ing)?\s+opportunit|\bbidding\s+to\s+GC\b"),
]
ORG_NAME = r"([A-Z][A-Za-z0-9&.,' -]{2,60})"
ROLE_LABELS = [
    ("General Contractor", r"(?:general\s+contractor|GC|builder)\s*[:\-]\s*" + ORG_NAME),
    ("Developer", r"(?:developer|client|owner)\s*[:\-]\s*" + ORG_NAME),
    ("Architect", r"(?:architect(?:ural)?(?:\s+firm)?)\s*[:\-]\s*" + ORG_NAME),
    ("Engineer", r"(?:civil\s+)?engineer(?:ing)?(?:\s+firm)?\s*[:\-]\s*" + ORG_NAME),
]
RISKS = [
    ("Document language may exclude fencing scope.", r"no\s+fence|fencing\s+not\s+required|exclude(?:s|d)?\s+fence"),
    ("GC may self-perform portions of the work.", r"self[-\s]?perform|in[-\s]?house"),
    ("Project may already be complete or finaled.", r"complete[d]?\s+project|finaled|closed\s+permit"),
]
IDENTIFIERS = {
    "project_number": r"(?i)\b(?:PLN|DRS|RZ|SP|GP|ZOB|CONTROL)[-\s]?\d{2,6}\b",
    "case_number": r"(?i)\b[A-Z]{2,5}\d{2,6}[-\dA-Z]*\b",
    "planning_number": r"(?i)\bPLN[-\s]?\d{2}[-\s]?\d{3,6}\b",
    "apn": r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b",
    "parcel": r"(?i)\b(?:lot|parcel)\s+\d+[A-Z-]*",
    "address": r"(?i)\b\d{3,6}\s+[A-Z0-9][A-Z0-9\s.'-]+(?:RD|ROAD|ST|STREET|AVE|AVENUE|LN|LANE|DR|DRIVE|BLVD|COURT|CT)\b",
}
PHONE_TEXT = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL_TEXT = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
SCRAPE_BLOCKED_EMAILS = r"(example\.com|sentry\.|wixpress|cloudflare|schema\.org|github\.com|w3\.org|domain\.com|email\.com|caanet\.org|forcabinetsake\.com)"
ENTITY_ADDRESS = r"\b\d{1,6}\s+[A-Z][A-Za-z0-9 .'#-]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Dr|Drive|Way|Ln|Lane|Ct|Court)\b"
ENTITY_PARCEL = r"(?i)\b(?:APN|parcel)\s*[:#]?\s*([A-Z0-9-]{5,})\b"
ENTITY_SUBDIVISION_CUE = r"\b(villages?\s+at|the\s+lakes?\s+at|unit\s+\d+|lot\s+\d+|subdivision|master\s*plan|tract\s+\d+|northlake|lakelet)\b"
ENTITY_VILLAGE = r"\b(?:Villages?|Lakes?|Northlake|Lakelet)\s+(?:at\s+)?[A-Z][A-Za-z0-9 &'-]{2,40}"
ENTITY_SUBDIVISION = r"\b[A-Z][A-Za-z0-9 &'-]{2,40}\s+(?:Subdivision|Community|Homes|Village)\b"
# evidence signals: (group, label, pattern, validator)
EVIDENCE_SIGNALS = [
    ("strong", "Fence installation reference", r"\b(install|raise|build|building|construct|provide|supply).{0,40}\bfenc(?:e|es|ing)\b|\bfenc(?:e|es|ing)\b.{0,40}\b(install|raise|build|construct|provide|supply|height)\b|\b(new fence|fence height|pool safety fencing|security fence|gates/fence|fencing with gate|fence package|fencing package)\b", "fence"),
    ("strong", "Fence package reference", r"\b(fence height|new fence|pool safety fencing|security fence|gates/fence|fencing with gate|fence package|fencing package)\b", ""),
    ("strong", "Chain-link fencing reference", r"chain[-\s]?link", ""),
    ("strong", "Ornamental or wrought-iron reference", r"ornamental iron|wrought iron", ""),
    ("strong", "Gate installation reference", r"\b(new\s*\(?gates?\)?|install(?:ation)? of .{0,40}gate|building a .{0,30}gate|slid(?:e|ing) gates?|automat(?:ic|ed) (?:slide )?gates?|steel gate|vehicle gate|pedestrian gate|security gate|ada ped|ped gates?|supply and install.{0,60}gate)\b", "gate"),
    ("strong", "Detention basin fencing reference", r"detention basin[^.]{0,80}\bfenc(?:e|ing)\b|\bfenc(?:e|ing)\b[^.]{0,80}detention basin", ""),
    ("strong", "Public facility fencing reference", r"park fencing|trail fencing|school fencing|sports field fencing", ""),
    ("weak", "Incidental gate mention", r"\bgates?\b", "gate"),
    ("weak", "Incidental fence mention", r"\bfenc(?:e|es|ing)\b", "fence"),
    ("weak", "Enclosure or screen-wall mention", r"\benclosure\b|screen wall", ""),
    ("negative", "Primary electrical / landscape lighting work", r"electrical for landscaping|commercial electrical service|electrical service pedestal|landscape lighting|service pedestal", ""),
    ("negative", "Creek, drainage, or water-quality work without fence reference", r"creek restoration|creek|water quality|drainage|stormwater|hydrology", ""),
    ("negative", "Pipeline or utility work without fence reference", r"pipeline|utility relocation|water main|sewer|trunk", ""),
    ("negative", "Electrical or solar retrofit evidence", r"electrical upgrade|solar|photovoltaic|pv|energy storage|electrical service", ""),
    ("negative", "Roof replacement evidence", r"roof replacement|roof|reroof|tpo|membrane|capsheet", ""),
    ("negative", "HVAC-only replacement evidence", r"hvac|mechanical|package unit|air conditioning", ""),
    ("negative", "Interior or tenant-improvement-only evidence", r"interior remodel|kitchen|bathroom|flooring|painting|tenant improvement", ""),
]
# where a signal can start: (lower-case text that each of its matches holds one of, characters of the match before that text at most)
EVIDENCE_CUES = {
    "Fence installation reference": [("fenc", 49)],
    "Fence package reference": [("fenc", 12)],
    "Chain-link fencing reference": [("chain", 0)],
    "Ornamental or wrought-iron reference": [("ornamental iron", 0), ("wrought iron", 0)],
    "Gate installation reference": [("gate", 78), ("ada ped", 0), ("new", 0)],
    "Detention basin fencing reference": [("detention basin", 87)],
    "Public facility fencing reference": [("park fencing", 0), ("trail fencing", 0), ("school fencing", 0), ("sports field fencing", 0)],
    "Incidental gate mention": [("gate", 0)],
    "Incidental fence mention": [("fenc", 0)],
    "Enclosure or screen-wall mention": [("enclosure", 0), ("screen wall", 0)],
    "Primary electrical / landscape lighting work": [("electrical for landscaping", 0), ("commercial electrical service", 0), ("landscape lighting", 0), ("electrical service pedestal", 0), ("service pedestal", 0)],
    "Creek, drainage, or water-quality work without fence reference": [("creek", 0), ("water quality", 0), ("drainage", 0), ("stormwater", 0), ("hydrology", 0)],
    "Pipeline or utility work without fence reference": [("pipeline", 0), ("utility relocation", 0), ("water main", 0), ("sewer", 0), ("trunk", 0)],
    "Electrical or solar retrofit evidence": [("electrical upgrade", 0), ("solar", 0), ("photovoltaic", 0), ("pv", 0), ("energy storage", 0), ("electrical service", 0)],
    "Roof replacement evidence": [("roof", 0), ("tpo", 0), ("membrane", 0), ("capsheet", 0)],
    "HVAC-only replacement evidence": [("hvac", 0), ("mechanical", 0), ("package unit", 0), ("air conditioning", 0)],
    "Interior or tenant-improvement-only evidence": [("interior remodel", 0), ("kitchen", 0), ("bathroom", 0), ("flooring", 0), ("painting", 0), ("tenant improvement", 0)],
}
FENCE_INTENT = r"\b(install|raise|new fence|build|building|construct|provide|supply|pool safety|security fence|fence height|fencing with|gates/fence|permit for fence|fence built|chain[-\s]?link)\b"
FENCE_INCIDENTAL = r"\b(behind|in front of)\b[^.]*\bfence\b|\bfrom (?:the )?fence/property line\b|\bfor fence or structure\b|\bfence note revised\b|\btowards back fence\b|\bthere is a fence\b|\bremove the fence\b|\bif needed only\b"
FENCE_OTHER_WORK = r"\bhvac\b|\bsewer\b|\bsolar\b|\bcarport\b|\belec\b|\belectrical\b|\bsmud\b|\baddition and remodel\b|\bpipe burst\b|\binversion liner\b"
FENCE_OTHER_WORK_UNLESS = r"\b(fence|fencing)\b.{0,40}\b(install|new|raise|build|provide|permit)\b|\b(install|new|raise|build|provide|permit).{0,40}\b(fence|fencing)\b"
FENCE_WORDS = r"\b(fence|fences|fencing)\b"
FENCE_ACTIONS = r"\b(install|raise|new|build|construct|provide|supply|height|package|security|pool)\b"
GATE_STREET = r"\b(ave|avenue|rd|road|st|street|blvd|drive|dr|way|ln|lane)\b"
GATE_ACTION = r"\b(install|new|build|automatic|sliding|security|entry|ped|vehicle|fence|gates?)\b.{0,40}\bgates?\b|\bgates?\b.{0,40}\b(install|new|build|automatic|sliding|security|entry|ped|vehicle|fence)\b"
GATE_DIRECT = r"\b(new\s*\(?gates?|install|sliding gate|automatic gate|entry gate|security gate|ped gate|vehicle gate)\b"
GATE_OTHER_WORK = r"\b(hvac|solar|battery|reroof|roof|sewer|pipe burst)\b"
GATE_OTHER_WORK_UNLESS = r"\b(install|new|build|automatic|sliding|security|entry|ped|vehicle|fence)\b"
# trade reasons: (trade, any-of substrings, reason, confidence)
TRADE_REASONS = [
    ("Fencing", ["logistics", "industrial"], "Industrial or logistics facility implies perimeter and access-control needs.", 0.78),
    ("Fencing", ["outdoor", "storage"], "Outdoor storage area suggests fencing or security perimeter scope.", 0.80),
    ("Fencing", ["subdivision", "production home", "master plan"], "Residential subdivision can require perimeter, yard, or phase fencing.", 0.74),
    ("Fencing", ["demo", "demolition"], "Demolition activity may require temporary safety fencing.", 0.64),
    ("Fencing", ["pool", "spa"], "Pool or spa scope often requires code-compliant barriers.", 0.62),
    ("Concrete", ["foundation", "footing"], "Foundation or footing language points to concrete scope.", 0.84),
    ("Concrete", ["flatwork", "slab"], "Flatwork or slab language supports concrete relevance.", 0.82),
    ("Concrete", ["parking", "site"], "Site or parking improvements can require concrete work.", 0.68),
    ("Concrete", ["pool", "spa"], "Pool or spa construction can include concrete and hardscape scope.", 0.66),
    ("Electrical", ["electric", "service"], "Electrical service or power upgrade appears in source text.", 0.86),
    ("Electrical", ["solar", "pv", "battery"], "Solar, PV, or battery scope requires electrical work.", 0.88),
    ("Electrical", ["utility"], "Utility connection language supports electrical opportunity.", 0.74),
    ("Roofing", ["roof", "tpo"], "Roofing material or roof work appears directly in the source record.", 0.90),
    ("Roofing", ["addition", "new building"], "New structures or additions can create roofing scope.", 0.62),
    ("HVAC", ["hvac", "heat pump", "mechanical"], "HVAC, heat pump, or mechanical language appears in source text.", 0.90),
    ("HVAC", ["commercial"], "Commercial occupancy can create HVAC replacement or commissioning work.", 0.58),
    ("Landscaping", ["residential", "subdivision"], "Residential development commonly creates landscape and exterior improvement scope.", 0.58),
    ("Landscaping", ["site improvement"], "Site improvement language supports landscaping relevance.", 0.66),
    ("Site work", ["sewer", "utility"], "Sewer or utility language supports site work scope.", 0.86),
    ("Site work", ["grading", "demo"], "Grading or demolition indicates site preparation work.", 0.78),
]
