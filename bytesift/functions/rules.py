"""Names of journal flags, language rules, brands of media files."""

#: Fixed values, in order: bits of a journal record's reason and their names.
REASONS = [
    (0x00000001, "DATA_OVERWRITE"),
    (0x00000002, "DATA_EXTEND"),
    (0x00000004, "DATA_TRUNCATION"),
    (0x00000100, "FILE_CREATE"),
    (0x00000200, "FILE_DELETE"),
    (0x00001000, "RENAME_OLD_NAME"),
    (0x00002000, "RENAME_NEW_NAME"),
    (0x00008000, "BASIC_INFO_CHANGE"),
    (0x80000000, "CLOSE"),
]

#: Fixed values: (language, extension, patterns of weight 3, patterns of weight 1); earlier languages win ties.
LANGUAGES = [
    (
        "rust",
        "rs",
        [r"\bfn\s+main\s*\(", r"\bpub\s+fn\b", r"#\[derive\(", r"\buse\s+std::", r"\bimpl\b[^\n]{0,60}\bfor\b", r"\blet\s+mut\b", r"println!\s*\(", r"->\s*Result<", r"#!\[", r"\bmatch\b[^\n]{0,40}\{"],
        [r"\bfn\s+\w+\s*\(", r"\bstruct\s+\w+", r"\benum\s+\w+", r"\bpub\s+(struct|enum|mod|trait)\b", r"::<"],
    ),
    (
        "kotlin",
        "kt",
        [r"\bfun\s+main\s*\(", r"@Composable", r"import\s+androidx", r"\bval\s+\w+\s*[:=]", r"\bvar\s+\w+\s*[:=]", r"\bsuspend\s+fun\b", r"\bcompanion\s+object\b", r":\s*ViewModel", r"\bpackage\s+[a-z][\w.]+"],
        [r"\bfun\s+\w+\s*\(", r"\bclass\s+\w+", r"\bobject\s+\w+", r"\boverride\b", r"\bdata\s+class\b"],
    ),
    (
        "python",
        "py",
        [r"\bdef\s+\w+\s*\(", r"(?m)^\s*import\s+\w+", r"(?m)^\s*from\s+[\w.]+\s+import", r"if\s+__name__\s*==", r"\bself\.", r"(?m)^#!.*python", r"\basync\s+def\b"],
        [r"\bclass\s+\w+\s*[:(]", r"\bprint\s*\(", r"\breturn\b", r"\bwith\s+open\b", r"->\s*None\b"],
    ),
    (
        "solidity",
        "sol",
        [
            r"pragma\s+solidity",
            r"\bcontract\s+\w+",
            r"\binterface\s+\w+",
            r"\blibrary\s+\w+",
            r"\bmsg\.sender\b",
            r"\bmapping\s*\(",
            r"\bemit\s+\w+",
            r"\bfunction\s+\w+\s*\([^)]*\)\s*(public|external|internal|private)",
            r"// SPDX-License-Identifier",
        ],
        [r"\bfunction\s+\w+\s*\(", r"\bevent\s+\w+", r"\brequire\s*\(", r"\buint256\b", r"\baddress\b"],
    ),
    (
        "javascript",
        "js",
        [r"\bfunction\s+\w+\s*\(", r"=>\s*\{", r"\bconst\s+\w+\s*=", r"\bmodule\.exports\b", r"\brequire\s*\(", r"export\s+(default|const|function)"],
        [r"\blet\s+\w+\s*=", r"console\.log", r"\bawait\b"],
    ),
    ("go", "go", [r"(?m)^package\s+\w+", r"\bfunc\s+\w+\s*\(", r"\bimport\s*\(", r"\bfmt\.", r":=", r"\bpackage\s+main\b"], [r"\bfunc\b", r"\bdefer\b", r"\bgo\s+\w+\("]),
    ("c_cpp", "c", [r"#include\s*<", r"\bint\s+main\s*\(", r"\bprintf\s*\(", r"\bstd::", r"#define\s+\w+", r"\bvoid\s+\w+\s*\("], [r"\breturn\s+0;", r"\bstruct\s+\w+", r"\btypedef\b"]),
    ("json", "json", [r"^\s*[\{\[]", r'"\w+"\s*:\s*[\{\["\d]'], [r'"\w+"\s*:']),
    ("toml_cfg", "toml", [r"\[dependencies\]", r"\[package\]", r"(?m)^\w[\w.-]*\s*=\s*"], [r"\bversion\s*=", r"\[\w+\]"]),
    ("markdown", "md", [r"(?m)^#{1,6}\s+\S", r"```", r"(?m)^\s*[-*]\s+\S"], [r"\[.+\]\(.+\)"]),
]
STRONG, WEAK, LEAST = 3, 1, 4

#: Brands of ISO media files.
PHOTO_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "mif1", "msf1", "avif", "avis"]
VIDEO_BRANDS = ["isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "mp4v", "mmp4", "M4V ", "M4VH", "M4VP", "qt  ", "3gp", "3g2", "dash", "avc1", "f4v "]
