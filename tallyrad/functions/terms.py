"""Word lists, patterns and codes that must equal those of the behaviour asked for, as results depend on them."""

MODALITIES = ["CT", "MRI", "US", "XR", "NM_PET", "MAMMO", "FLUORO", "PROCEDURE", "OTHER"]

# Abbreviations in exam titles.
ABBREVIATIONS = {
    "w/o": "without",
    "wo": "without",
    "w/": "with",
    "w": "with",
    "c/": "contrast",
    "con": "contrast",
    "cont": "contrast",
    "wcon": "with contrast",
    "wwocon": "with and without contrast",
    "cta": "ct angiogram",
    "mra": "mr angiogram",
    "mri": "mri",
    "mr": "mri",
    "us": "ultrasound",
    "u/s": "ultrasound",
    "xr": "xray",
    "x-ray": "xray",
    "nm": "nuclear medicine",
    "pet": "positron emission tomography",
    "fluoro": "fluoroscopy",
    "abd": "abdomen",
    "pel": "pelvis",
    "a/p": "abdomen pelvis",
    "ap": "abdomen pelvis",
    "c/a/p": "chest abdomen pelvis",
    "cap": "chest abdomen pelvis",
    "chst": "chest",
    "hd": "head",
    "nk": "neck",
    "sp": "spine",
    "lspine": "lumbar spine",
    "l-spine": "lumbar spine",
    "cspine": "cervical spine",
    "c-spine": "cervical spine",
    "tspine": "thoracic spine",
    "t-spine": "thoracic spine",
    "lsp": "lumbar spine",
    "csp": "cervical spine",
    "tsp": "thoracic spine",
    "brnst": "brain stem",
    "brn": "brain",
    "lt": "left",
    "rt": "right",
    "bil": "bilateral",
    "bi": "bilateral",
    "ext": "extremity",
    "ue": "upper extremity",
    "le": "lower extremity",
    "shldr": "shoulder",
    "kn": "knee",
    "ank": "ankle",
    "wr": "wrist",
    "hp": "hip",
    "iv": "intravenous",
    "2v": "two view",
    "1v": "one view",
    "3v": "three view",
    "wwo": "with and without",
    "w-wo": "with and without",
    "w/wo": "with and without",
    "wowcon": "without and with contrast",
    "dx": "diagnostic",
    "scr": "screening",
    "compl": "complete",
    "comp": "complete",
    "lim": "limited",
    "bilat": "bilateral",
    "incl": "including",
    "excl": "excluding",
    "cad": "cad",
}


# Protocol names and what they order.
PROTOCOLS = {
    "code stroke": "CTA Head and Neck with Contrast",
    "stroke alert": "CTA Head and Neck with Contrast",
    "stroke protocol": "CTA Head and Neck with Contrast",
    "cta stroke": "CTA Head and Neck with Contrast",
    "ct angiogram code stroke": "CTA Head and Neck with Contrast",
    "code pe": "CTA Chest Pulmonary Embolism with Contrast",
    "pe protocol": "CTA Chest Pulmonary Embolism with Contrast",
    "cta pe": "CTA Chest Pulmonary Embolism with Contrast",
    "ctpe": "CTA Chest Pulmonary Embolism with Contrast",
    "ct aorta": "CTA Aorta with Contrast",
    "cta aorta": "CTA Aorta with Contrast",
    "aortic dissection": "CTA Aorta with Contrast",
    "trauma ct": "CT Chest Abdomen Pelvis with Contrast",
    "pan scan": "CT Chest Abdomen Pelvis with Contrast",
    "panscan": "CT Chest Abdomen Pelvis with Contrast",
    "trauma pan scan": "CT Chest Abdomen Pelvis with Contrast",
    "coronary cta": "CTA Coronary Arteries with Contrast",
    "cardiac cta": "CTA Coronary Arteries with Contrast",
    "renal stone": "CT Abdomen Pelvis without Contrast",
    "kidney stone": "CT Abdomen Pelvis without Contrast",
    "renal colic": "CT Abdomen Pelvis without Contrast",
    "brain mri": "MRI Brain without Contrast",
    "mri stroke": "MRI Brain without and with Contrast",
    "screening mammo": "Screening Mammography",
    "screening mammogram": "Screening Mammography",
    "screening mammography": "Screening Mammography",
    "diagnostic mammo": "Diagnostic Mammography",
    "diagnostic mammogram": "Diagnostic Mammography",
}


# Words of radiology titles.
EXPANSIONS = {
    "cta": "CT Angiogram",
    "mra": "MR Angiogram",
    "ct": "CT",
    "mri": "MRI",
    "mr": "MRI",
    "us": "Ultrasound",
    "u/s": "Ultrasound",
    "xr": "X-Ray",
    "x-ray": "X-Ray",
    "nm": "Nuclear Medicine",
    "pet": "PET",
    "pet/ct": "PET CT",
    "petct": "PET CT",
    "fluoro": "Fluoroscopy",
    "mammo": "Mammography",
    "dexa": "DEXA Bone Density",
    "dxa": "DEXA Bone Density",
    "w/o": "without Contrast",
    "w/": "with Contrast",
    "wo": "without Contrast",
    "wcon": "with Contrast",
    "wwocon": "with and without Contrast",
    "w/wo": "with and without Contrast",
    "wwo": "with and without Contrast",
    "w&wo": "with and without Contrast",
    "+c": "with Contrast",
    "-c": "without Contrast",
    "con": "Contrast",
    "noncon": "without Contrast",
    "non-con": "without Contrast",
    "nc": "without Contrast",
    "a/p": "Abdomen Pelvis",
    "ap": "Abdomen Pelvis",
    "c/a/p": "Chest Abdomen Pelvis",
    "cap": "Chest Abdomen Pelvis",
    "h&n": "Head and Neck",
    "h/n": "Head and Neck",
    "head neck": "Head and Neck",
    "head/neck": "Head and Neck",
    "abd": "Abdomen",
    "abdo": "Abdomen",
    "pel": "Pelvis",
    "chst": "Chest",
    "hd": "Head",
    "nk": "Neck",
    "brn": "Brain",
    "brnstem": "Brain Stem",
    "orb": "Orbits",
    "sp": "Spine",
    "c-spine": "Cervical Spine",
    "cspine": "Cervical Spine",
    "c spine": "Cervical Spine",
    "t-spine": "Thoracic Spine",
    "tspine": "Thoracic Spine",
    "t spine": "Thoracic Spine",
    "l-spine": "Lumbar Spine",
    "lspine": "Lumbar Spine",
    "l spine": "Lumbar Spine",
    "ls spine": "Lumbar Spine",
    "tlspine": "Thoracic Lumbar Spine",
    "tl spine": "Thoracic Lumbar Spine",
    "cl spine": "Cervical Lumbar Spine",
    "whole spine": "Whole Spine",
    "total spine": "Whole Spine",
    "ue": "Upper Extremity",
    "le": "Lower Extremity",
    "bilat": "Bilateral",
    "bil": "Bilateral",
    "lt": "Left",
    "rt": "Right",
    "shldr": "Shoulder",
    "kn": "Knee",
    "ank": "Ankle",
    "wr": "Wrist",
    "hp": "Hip",
    "fmr": "Femur",
    "tib": "Tibia",
    "hum": "Humerus",
    "elb": "Elbow",
    "fgr": "Finger",
    "toe": "Toe",
    "ft": "Foot",
    "frt": "Forearm",
    "abd pelvis": "Abdomen Pelvis",
    "liver": "Liver",
    "gi": "GI",
    "hepat": "Hepatic",
    "panc": "Pancreas",
    "renal": "Renal",
    "kub": "Kidneys Ureters Bladder",
    "biliary": "Biliary",
    "prost": "Prostate",
    "ov": "Ovaries",
    "uterus": "Uterus",
    "thyroid": "Thyroid",
    "parath": "Parathyroid",
    "adrenal": "Adrenal",
    "endo": "Endoscopy",
    "cardiac": "Cardiac",
    "pulm": "Pulmonary",
    "pe": "Pulmonary Embolism",
    "tia": "TIA",
    "w/contrast": "with Contrast",
    "screening": "Screening",
    "diag": "Diagnostic",
    "dx": "Diagnostic",
    "biopsy": "Biopsy",
    "guided": "Guided",
    "fluoro-guided": "Fluoroscopy Guided",
    "drain": "Drainage",
    "inject": "Injection",
    "aspir": "Aspiration",
    "art": "Arthrography",
    "arthro": "Arthrography",
    "myelogram": "Myelogram",
    "myelo": "Myelogram",
    "angio": "Angiography",
    "2v": "2 View",
    "3v": "3 View",
    "4v": "4 View",
}

# Words without meaning in exam titles.
TITLE_NOISE = [
    "code", "stroke", "protocol", "stat", "portable", "exam", "study", "scan", "imaging", "radiology", "diagnostic",
    "order", "req", "request",
]

# Words without meaning in radiology titles.
RADIOLOGY_NOISE = [
    "code", "protocol", "stat", "portable", "exam", "study", "scan", "imaging", "radiology", "order", "req", "request",
    "series", "sequence", "tech", "alert", "urgent", "routine", "emergent", "inpatient", "outpatient", "ip", "op",
    "add", "on", "limited", "complete",
]

# Parts of the body.
BODY_PARTS = [
    "head", "brain", "neck", "chest", "abdomen", "pelvis", "spine", "cervical", "thoracic", "lumbar", "sacral",
    "coccyx", "shoulder", "elbow", "wrist", "hand", "finger", "thumb", "hip", "knee", "ankle", "foot", "toe",
    "extremity", "upper extremity", "lower extremity", "femur", "tibia", "fibula", "humerus", "radius", "ulna",
    "orbit", "sinus", "temporal", "mastoid", "facial", "liver", "pancreas", "kidney", "renal", "adrenal", "spleen",
    "bladder", "prostate", "uterus", "ovary", "breast", "thyroid", "aorta", "pulmonary", "coronary", "cardiac",
    "heart", "hepatic", "biliary", "bowel", "colon", "rectum", "fetal", "obstetric",
]
BODY_PHRASES = ["head and neck", "abdomen and pelvis", "abdomen pelvis", "chest abdomen pelvis"]

# Signs of a modality in a normalised title, in order.
TITLE_MODALITY = [
    (r"(?i)\bct\s*angiogram\b|\bcta\b", "CT"),
    (r"(?i)\bmr\s*angiogram\b|\bmra\b", "MRI"),
    (r"(?i)\bct\b|\bcat scan\b", "CT"),
    (r"(?i)\bmri\b|\bmr\b", "MRI"),
    (r"(?i)\bpet\b", "NM_PET"),
    (r"(?i)\bnuclear\b|\bnm\b", "NM_PET"),
    (r"(?i)\bultrasound\b|\bsonogram\b|\bus\b|\bechocardiogram\b", "US"),
    (r"(?i)\bmammo\b|\bmammogram\b|\bmammography\b", "MAMMO"),
    (r"(?i)\bx.?ray\b|\bxr\b|\bradiograph\b", "XR"),
    (r"(?i)\bfluoroscopy\b|\bfluoro\b|\bbarium\b", "FLUORO"),
]

# Signs of a modality in a fee schedule's description, in order.
DESCRIPTION_MODALITY = [
    (r"(?i)\bct\s*angiograph|\bcta\b", "CT"),
    (r"(?i)\bmr\s*angiograph|\bmra\b", "MRI"),
    (r"(?i)\bcomputed tomograph|\bcat scan\b|\bct\b", "CT"),
    (r"(?i)\bmagnetic resonance|\bmri\b|\bmr\b", "MRI"),
    (r"(?i)\bpet\b", "NM_PET"),
    (r"(?i)\bnuclear medicine|\bscintigraph|\bnm\b", "NM_PET"),
    (r"(?i)\bultrasound|\bsonograph|\bechocard", "US"),
    (r"(?i)\bmammograph|\bmammo\b", "MAMMO"),
    (r"(?i)\bradiograph|x-?ray|\bxr\b|\bchest film\b", "XR"),
    (r"(?i)\bfluoroscop|\bbarium", "FLUORO"),
]

# Words of titles that are written in capitals, and in small letters unless they come first.
UPPER_WORDS = ["CT", "MRI", "CTA", "MRA", "PET", "DEXA", "US", "XR", "NM"]
LOWER_WORDS = ["and", "or", "of", "the", "a", "an", "in", "on", "at", "with", "without"]

# Phrases of descriptions and their short forms.
PHRASES = [
    ("CT ANGIOGRAPHY", "CT ANGIO"), ("CT ANGIOGRAM", "CT ANGIO"), ("CTA", "CT ANGIO"),
    ("WITH AND WITHOUT CONTRAST", "WWO"), ("WITHOUT AND WITH CONTRAST", "WWO"), ("WITH AND WITHOUT", "WWO"),
    ("WITHOUT AND WITH", "WWO"), ("W / WO", "WWO"), ("W /W O", "WWO"), ("W WO", "WWO"), ("W/WO", "WWO"),
    ("W-WO", "WWO"), ("WITHOUT CONTRAST", "WO"), ("WITHOUT IV CONTRAST", "WO"), ("W / O CONTRAST", "WO"),
    ("W / O", "WO"), ("W/O CONTRAST", "WO"), ("W/O", "WO"), ("NON CONTRAST", "WO"), ("NONCONTRAST", "WO"),
    ("WITH CONTRAST", "W"), ("WITH IV CONTRAST", "W"), ("W CONTRAST", "W"), ("W DYE", "W"), ("W / CONTRAST", "W"),
    ("W/ CONTRAST", "W"), ("W/CONTRAST", "W"), ("WITH DYE", "W"), ("ABDOMEN AND PELVIS", "ABD AND PEL"),
    ("ABDOMEN & PELVIS", "ABD AND PEL"), ("ABDOMEN / PELVIS", "ABD AND PEL"), ("ABD / PELVIS", "ABD AND PEL"),
    ("ABD / PEL", "ABD AND PEL"), ("ABD PELVIS", "ABD AND PEL"), ("ABDOMEN PELVIS", "ABD AND PEL"),
    ("ABD PEL", "ABD AND PEL"), ("ABDOMEN", "ABD"), ("PELVIS", "PEL"), ("CHEST", "THORAX"),
]

# Rewrites of descriptions between the two rounds of phrases, in order.
REWRITES = [
    (r"\bCT\s+THORAX\b", "CT THORAX"), (r"\bMR\b", "MRI"), (r"\bU\s*/\s*S\b", "US"), (r"\bULTRASOUND\b", "US"),
    (r"\bX\s*RAY\b", "XR"), (r"\bX-RAY\b", "XR"), (r"\bRADIOGRAPH\b", "XR"), (r"\bONE VIEW\b", "1 VIEW"),
    (r"\bTWO VIEWS?\b", "2 VIEWS"), (r"\b1V\b", "1 VIEW"), (r"\b2V\b", "2 VIEWS"), (r"\bCOMPLETE\b", "COMPLETE"),
    (r"\bRIGHT UPPER QUADRANT\b", "RUQ"), (r"\bRUQ ABD\b", "RUQ"), (r"\bPULMONARY EMBOLISM\b", "PE"),
    (r"\bPE PROTOCOL\b", "PE"), (r"\bCONTRAST\b", ""), (r"\bWITHOUT\b", "WO"), (r"\bWITH\b", "W"), (r"\bDYE\b", ""),
    (r"\bAND AND\b", "AND"),
]
LAST_REWRITES = [(r"\bABDOMEN\b", "ABD"), (r"\bPELVIS\b", "PEL"), (r"\bCHEST\b", "THORAX")]

# Descriptions that are mapped without a search.
COMMON_CODES = [
    ("CT HEAD WO", ["70450"]), ("CT CHEST W", ["71260"]), ("CT CHEST WO", ["71250"]),
    ("CT CHEST ABDOMEN PELVIS W", ["71260", "74177"]), ("CT ABDOMEN PELVIS W", ["74177"]),
    ("CT ABDOMEN PELVIS WO", ["74176"]), ("CT ABDOMEN PELVIS WWO", ["74178"]), ("CTA CHEST PE", ["71275"]),
    ("CTA HEAD", ["70496"]), ("CTA NECK", ["70498"]), ("MRI BRAIN WWO", ["70553"]), ("US ABDOMEN COMPLETE", ["76700"]),
    ("US RUQ", ["76705"]), ("XR CHEST 1 VIEW", ["71045"]), ("XR CHEST 2 VIEWS", ["71046"]),
]

# Ranges of codes by modality, asked in order. "plain" ranges hold for plain films only.
CODE_RANGES = [
    ("XR", [(70010, 70110), (71045, 71048), (72020, 72120)]),
    ("XR plain", [(73000, 73225), (73500, 73660)]),
    ("XR", [(74000, 74022)]),
    ("CT", [(70450, 70498), (71250, 71275), (72125, 72133), (72191, 72194), (73200, 73206), (73700, 73706), (74150, 74178), (75571, 75574)]),
    ("MRI", [(70540, 70559), (71550, 71555), (72141, 72159), (72195, 72198), (73218, 73225), (73718, 73725), (74181, 74183)]),
    ("US", [(76506, 76999)]),
    ("MAMMO", [(77046, 77067)]),
    ("NM_PET", [(78000, 79999)]),
    ("FLUORO", [(74210, 74363), (74400, 74485)]),
    ("PROCEDURE", [(19081, 19086), (32550, 32674), (36000, 36598), (37184, 37241), (47490, 47544), (49083, 49423), (50382, 50435)]),
]
MAMMO_PREFIXES = ["G0202", "G0204", "G0206", "G0279"]
