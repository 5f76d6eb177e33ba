"""Fixed tables of the analyses: card phrases, stop words, languages, paper subjects.

All of them are fixed values: results depend on their exact entries.
"""

from __future__ import annotations

# Fields looked for in a card, by category.
CARD_FIELDS = {
    "Model Details": ["model description", "developed by", "model type", "language", "license", "base model", "model sources",
                      "library name", "pipeline tag"],
    "Uses": ["intended uses", "direct use", "downstream use", "out of scope use", "limitations", "bias"],
    "Training": ["training data", "preprocessing", "training procedure", "training hyperparameters", "framework versions",
                 "mixed precision training"],
    "Evaluation": ["evaluation", "testing data", "testing factors", "testing metrics", "results", "results summary"],
    "Technical": ["model specs", "compute infrastructure", "hardware requirements", "software", "architecture", "tokenizer config"],
    "Environmental": ["hardware type", "hours used", "cloud provider", "cloud region", "co2 emitted"],
    "Documentation": ["citation", "citation bibtex", "citation apa", "glossary", "more information", "model card authors",
                      "model card contact"],
}

# English stop words (the list of the Natural Language Toolkit).
STOP_WORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't
didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan
shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()

# ISO 639-1 codes and reference names.
LANGUAGES = {
    "aa": "Afar", "ab": "Abkhazian", "ae": "Avestan", "af": "Afrikaans", "ak": "Akan", "am": "Amharic", "an": "Aragonese",
    "ar": "Arabic", "as": "Assamese", "av": "Avaric", "ay": "Aymara", "az": "Azerbaijani", "ba": "Bashkir", "be": "Belarusian",
    "bg": "Bulgarian", "bi": "Bislama", "bm": "Bambara", "bn": "Bengali", "bo": "Tibetan", "br": "Breton", "bs": "Bosnian",
    "ca": "Catalan", "ce": "Chechen", "ch": "Chamorro", "co": "Corsican", "cr": "Cree", "cs": "Czech", "cu": "Church Slavic",
    "cv": "Chuvash", "cy": "Welsh", "da": "Danish", "de": "German", "dv": "Dhivehi", "dz": "Dzongkha", "ee": "Ewe",
    "el": "Modern Greek (1453-)", "en": "English", "eo": "Esperanto", "es": "Spanish", "et": "Estonian", "eu": "Basque",
    "fa": "Persian", "ff": "Fulah", "fi": "Finnish", "fj": "Fijian", "fo": "Faroese", "fr": "French", "fy": "Western Frisian",
    "ga": "Irish", "gd": "Scottish Gaelic", "gl": "Galician", "gn": "Guarani", "gu": "Gujarati", "gv": "Manx", "ha": "Hausa",
    "he": "Hebrew", "hi": "Hindi", "ho": "Hiri Motu", "hr": "Croatian", "ht": "Haitian", "hu": "Hungarian", "hy": "Armenian",
    "hz": "Herero", "ia": "Interlingua (International Auxiliary Language Association)", "id": "Indonesian", "ie": "Interlingue",
    "ig": "Igbo", "ii": "Sichuan Yi", "ik": "Inupiaq", "io": "Ido", "is": "Icelandic", "it": "Italian", "iu": "Inuktitut",
    "ja": "Japanese", "jv": "Javanese", "ka": "Georgian", "kg": "Kongo", "ki": "Kikuyu", "kj": "Kuanyama", "kk": "Kazakh",
    "kl": "Kalaallisut", "km": "Khmer", "kn": "Kannada", "ko": "Korean", "kr": "Kanuri", "ks": "Kashmiri", "ku": "Kurdish",
    "kv": "Komi", "kw": "Cornish", "ky": "Kirghiz", "la": "Latin", "lb": "Luxembourgish", "lg": "Ganda", "li": "Limburgan",
    "ln": "Lingala", "lo": "Lao", "lt": "Lithuanian", "lu": "Luba-Katanga", "lv": "Latvian", "mg": "Malagasy",
    "mh": "Marshallese", "mi": "Maori", "mk": "Macedonian", "ml": "Malayalam", "mn": "Mongolian", "mr": "Marathi",
    "ms": "Malay (macrolanguage)", "mt": "Maltese", "my": "Burmese", "na": "Nauru", "nb": "Norwegian Bokmål",
    "nd": "North Ndebele", "ne": "Nepali (macrolanguage)", "ng": "Ndonga", "nl": "Dutch", "nn": "Norwegian Nynorsk",
    "no": "Norwegian", "nr": "South Ndebele", "nv": "Navajo", "ny": "Nyanja", "oc": "Occitan (post 1500)", "oj": "Ojibwa",
    "om": "Oromo", "or": "Oriya (macrolanguage)", "os": "Ossetian", "pa": "Panjabi", "pi": "Pali", "pl": "Polish",
    "ps": "Pushto", "pt": "Portuguese", "qu": "Quechua", "rm": "Romansh", "rn": "Rundi", "ro": "Romanian", "ru": "Russian",
    "rw": "Kinyarwanda", "sa": "Sanskrit", "sc": "Sardinian", "sd": "Sindhi", "se": "Northern Sami", "sg": "Sango",
    "sh": "Serbo-Croatian", "si": "Sinhala", "sk": "Slovak", "sl": "Slovenian", "sm": "Samoan", "sn": "Shona", "so": "Somali",
    "sq": "Albanian", "sr": "Serbian", "ss": "Swati", "st": "Southern Sotho", "su": "Sundanese", "sv": "Swedish",
    "sw": "Swahili (macrolanguage)", "ta": "Tamil", "te": "Telugu", "tg": "Tajik", "th": "Thai", "ti": "Tigrinya",
    "tk": "Turkmen", "tl": "Tagalog", "tn": "Tswana", "to": "Tonga (Tonga Islands)", "tr": "Turkish", "ts": "Tsonga",
    "tt": "Tatar", "tw": "Twi", "ty": "Tahitian", "ug": "Uighur", "uk": "Ukrainian", "ur": "Urdu", "uz": "Uzbek", "ve": "Venda",
    "vi": "Vietnamese", "vo": "Volapük", "wa": "Walloon", "wo": "Wolof", "xh": "Xhosa", "yi": "Yiddish", "yo": "Yoruba",
    "za": "Zhuang", "zh": "Chinese", "zu": "Zulu",
}

# Subject codes of papers and their names.
SUBJECTS = {
    "astro-ph": "Astrophysics", "astro-ph.GA": "Astrophysics of Galaxies", "astro-ph.CO": "Cosmology and Nongalactic Astrophysics",
    "astro-ph.EP": "Earth and Planetary Astrophysics", "astro-ph.HE": "High Energy Astrophysical Phenomena",
    "astro-ph.IM": "Instrumentation and Methods for Astrophysics", "astro-ph.SR": "Solar and Stellar Astrophysics",
    "cond-mat": "Condensed Matter Physics", "cond-mat.dis-nn": "Disordered Systems and Neural Networks",
    "cond-mat.mtrl-sci": "Materials Science", "cond-mat.mes-hall": "Mesoscale and Nanoscale Physics",
    "cond-mat.other": "Other Condensed Matter", "cond-mat.quant-gas": "Quantum Gases", "cond-mat.soft": "Soft Condensed Matter",
    "cond-mat.stat-mech": "Statistical Mechanics", "cond-mat.str-el": "Strongly Correlated Electrons",
    "cond-mat.supr-con": "Superconductivity", "gr-qc": "General Relativity and Quantum Cosmology",
    "hep-ex": "High Energy Physics - Experiment", "hep-lat": "High Energy Physics - Lattice",
    "hep-ph": "High Energy Physics - Phenomenology", "hep-th": "High Energy Physics - Theory", "math-ph": "Mathematical Physics",
    "nlin": "Nonlinear Sciences", "nlin.AO": "Adaptation and Self-Organizing Systems",
    "nlin.CG": "Cellular Automata and Lattice Gases", "nlin.CD": "Chaotic Dynamics",
    "nlin.SI": "Exactly Solvable and Integrable Systems", "nlin.PS": "Pattern Formation and Solitons",
    "nucl-ex": "Nuclear Experiment", "nucl-th": "Nuclear Theory", "physics": "Physics", "physics.acc-ph": "Accelerator Physics",
    "physics.app-ph": "Applied Physics", "physics.ao-ph": "Atmospheric and Oceanic Physics", "physics.atom-ph": "Atomic Physics",
    "physics.atm-clus": "Atomic and Molecular Clusters", "physics.bio-ph": "Biological Physics",
    "physics.chem-ph": "Chemical Physics", "physics.class-ph": "Classical Physics", "physics.comp-ph": "Computational Physics",
    "physics.data-an": "Data Analysis, Statistics and Probability", "physics.flu-dyn": "Fluid Dynamics",
    "physics.gen-ph": "General Physics", "physics.geo-ph": "Geophysics", "physics.hist-ph": "History and Philosophy of Physics",
    "physics.ins-det": "Instrumentation and Detectors", "physics.med-ph": "Medical Physics", "physics.optics": "Optics",
    "physics.soc-ph": "Physics and Society", "physics.ed-ph": "Physics Education", "physics.plasm-ph": "Plasma Physics",
    "physics.pop-ph": "Popular Physics", "physics.space-ph": "Space Physics", "quant-ph": "Quantum Physics", "math": "Mathematics",
    "math.AG": "Algebraic Geometry", "math.AT": "Algebraic Topology", "math.AP": "Analysis of PDEs", "math.CT": "Category Theory",
    "math.CA": "Classical Analysis and ODEs", "math.CO": "Combinatorics", "math.AC": "Commutative Algebra",
    "math.CV": "Complex Variables", "math.DG": "Differential Geometry", "math.DS": "Dynamical Systems",
    "math.FA": "Functional Analysis", "math.GM": "General Mathematics", "math.GN": "General Topology",
    "math.GT": "Geometric Topology", "math.GR": "Group Theory", "math.HO": "History and Overview", "math.IT": "Information Theory",
    "math.KT": "K-Theory and Homology", "math.LO": "Logic", "math.MP": "Mathematical Physics", "math.MG": "Metric Geometry",
    "math.NT": "Number Theory", "math.NA": "Numerical Analysis", "math.OA": "Operator Algebras",
    "math.OC": "Optimization and Control", "math.PR": "Probability", "math.QA": "Quantum Algebra",
    "math.RT": "Representation Theory", "math.RA": "Rings and Algebras", "math.SP": "Spectral Theory",
    "math.ST": "Statistics Theory", "math.SG": "Symplectic Geometry", "cs": "Computer Science", "cs.AI": "Artificial Intelligence",
    "cs.CL": "Computation and Language", "cs.CC": "Computational Complexity",
    "cs.CE": "Computational Engineering, Finance, and Science", "cs.CG": "Computational Geometry",
    "cs.GT": "Computer Science and Game Theory", "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.CY": "Computers and Society", "cs.CR": "Cryptography and Security", "cs.DS": "Data Structures and Algorithms",
    "cs.DB": "Databases", "cs.DL": "Digital Libraries", "cs.DM": "Discrete Mathematics",
    "cs.DC": "Distributed, Parallel, and Cluster Computing", "cs.ET": "Emerging Technologies",
    "cs.FL": "Formal Languages and Automata Theory", "cs.GL": "General Literature", "cs.GR": "Graphics",
    "cs.AR": "Hardware Architecture", "cs.HC": "Human-Computer Interaction", "cs.IR": "Information Retrieval",
    "cs.IT": "Information Theory", "cs.LO": "Logic in Computer Science", "cs.LG": "Machine Learning",
    "cs.MS": "Mathematical Software", "cs.MA": "Multiagent Systems", "cs.MM": "Multimedia",
    "cs.NI": "Networking and Internet Architecture", "cs.NE": "Neural and Evolutionary Computing", "cs.NA": "Numerical Analysis",
    "cs.OS": "Operating Systems", "cs.OH": "Other Computer Science", "cs.PF": "Performance", "cs.PL": "Programming Languages",
    "cs.RO": "Robotics", "cs.SI": "Social and Information Networks", "cs.SE": "Software Engineering", "cs.SD": "Sound",
    "cs.SC": "Symbolic Computation", "cs.SY": "Systems and Control", "q-bio": "Quantitative Biology", "q-bio.BM": "Biomolecules",
    "q-bio.CB": "Cell Behavior", "q-bio.GN": "Genomics", "q-bio.MN": "Molecular Networks", "q-bio.NC": "Neurons and Cognition",
    "q-bio.OT": "Other Quantitative Biology", "q-bio.PE": "Populations and Evolution", "q-bio.QM": "Quantitative Methods",
    "q-bio.SC": "Subcellular Processes", "q-bio.TO": "Tissues and Organs", "q-fin": "Quantitative Finance",
    "q-fin.CP": "Computational Finance", "q-fin.EC": "Economics", "q-fin.GN": "General Finance", "q-fin.MF": "Mathematical Finance",
    "q-fin.PM": "Portfolio Management", "q-fin.PR": "Pricing of Securities", "q-fin.RM": "Risk Management",
    "q-fin.ST": "Statistical Finance", "q-fin.TR": "Trading and Market Microstructure", "stat": "Statistics",
    "stat.AP": "Applications", "stat.CO": "Computation", "stat.ML": "Machine Learning", "stat.ME": "Methodology",
    "stat.OT": "Other Statistics", "stat.TH": "Statistics Theory", "eess": "Electrical Engineering and Systems Science",
    "eess.AS": "Audio and Speech Processing", "eess.IV": "Image and Video Processing", "eess.SP": "Signal Processing",
    "eess.SY": "Systems and Control", "econ": "Economics", "econ.EM": "Econometrics", "econ.GN": "General Economics",
    "econ.TH": "Theoretical Economics",
}
