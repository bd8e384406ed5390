"""Word lists, patterns and tables of the engine."""

from __future__ import annotations

# ---- Fixed values: results depend on exactly these words, patterns and numbers. ----

#: Words without meaning in a question.
STOPWORDS = """
a an and are as at be been by can could do does for from had has have how
i if in into is it its of on or our shall should so than that the their
them then there these they this those to was we were what when where which
while who will with would you your given following each every any all
also only such must may might one two
""".split()

#: Words without meaning in code.
CODE_NOISE = """
self this true false none null undefined return var let const def class
function new else elif pass print import from as in is not and or if for
while end
""".split()

#: Question words and the words code has for them.
NL_TO_CODE = {
    "maximum": ["max"],
    "minimum": ["min"],
    "largest": ["max"],
    "smallest": ["min"],
    "sum": ["sum"],
    "total": ["sum"],
    "sort": ["sort", "sorted"],
    "sorted": ["sort", "sorted"],
    "ascending": ["sort"],
    "descending": ["sort", "reverse"],
    "reverse": ["reverse"],
    "modulo": ["mod", "pow"],
    "remainder": ["mod"],
    "divisible": ["mod"],
    "integer": ["int"],
    "integers": ["int", "map", "split"],
    "string": ["str", "input"],
    "strings": ["str", "input"],
    "characters": ["str", "ord"],
    "array": ["list", "arr", "range"],
    "sequence": ["list", "range"],
    "permutation": ["perm", "permutations"],
    "prime": ["prime", "sieve", "sqrt"],
    "gcd": ["gcd"],
    "divisor": ["gcd", "mod"],
    "graph": ["graph", "adj", "visited", "dfs", "bfs"],
    "vertices": ["adj", "visited", "graph"],
    "edges": ["adj", "graph"],
    "tree": ["parent", "children", "root", "dfs"],
    "shortest": ["bfs", "dijkstra", "heap", "dist"],
    "palindrome": ["palindrome", "reverse"],
    "substring": ["substr", "find", "count"],
    "subsequence": ["dp"],
    "binary": ["bin", "bit", "shift"],
    "xor": ["xor", "bit"],
    "queries": ["query", "range", "input"],
    "cases": ["range", "input", "int"],
    "matrix": ["grid", "matrix", "range"],
    "grid": ["grid", "matrix", "range"],
    "coordinates": ["sqrt", "abs", "math"],
    "distance": ["abs", "sqrt", "dist"],
    "ways": ["dp", "mod", "count"],
    "optimal": ["dp", "min", "max"],
    "greedy": ["sort", "min", "max"],
}

#: Suffixes a stem loses (the first that fits), and what takes their place.
STEM_SUFFIXES = [("ations", ""), ("ation", ""), ("ings", ""), ("ing", ""), ("ies", "y"), ("ed", ""), ("es", ""), ("s", "")]
STEM_LEAST = 3

WORD = r"[A-Za-z][A-Za-z0-9]*"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
DASHED_SECTION = r"^\s*-{2,}\s*(input|output|examples?|note|notes|constraints?|explanation)\s*-{2,}\s*$"
PLAIN_SECTION = r"^\s*(Input|Output|Examples?|Note)\s*:?\s*$"
KEPT_SECTIONS = ["input", "output", "constraint", "constraints"]
BLOCK_COMMENT = r"/\*.*?\*/"
STRING_LITERAL = r"(\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\n]*\"|'[^'\n]*')"
LINE_COMMENT = r"(#|//)(.*)$"

#: topic -> (pattern in questions, pattern in code), in the order of the topic vector.
TOPICS = {
    "graph": (
        r"\b(graph|vertex|vertices|edge|edges|node|nodes|path|connected|shortest|cycle|bfs|dfs|adjacen\w*|route|city|cities|road)\b",
        r"\b(adj|graph|visited|dfs|bfs|dijkstra|deque|heappush|heappop|edges|neighbors?|indeg|outdeg)\b",
    ),
    "tree": (
        r"\b(tree|root|leaf|leaves|parent|child|children|subtree|ancestor|lca)\b",
        r"\b(parent|children|subtree|root|depth|lca|tin|tout)\b",
    ),
    "dp": (
        r"\b(number of ways|minimum cost|maximum (sum|profit|value)|subsequence|knapsack|longest|optimal|modulo\s*10\^?9|998244353|dynamic programming)\b",
        r"(\bdp\b|\bdp\[|\bmemo\b|lru_cache|\bcache\b|\bf\[\w+\]\[\w+\])",
    ),
    "string": (
        r"\b(string|strings|substring|palindrome|characters?|letters?|lowercase|uppercase|word|words|alphabet)\b",
        r"(\.split\(|\.count\(|\[::-1\]|\bord\(|\bchr\(|\.join\(|\.lower\(|\.upper\(|\.find\(|\bstr\()",
    ),
    "math": (
        r"\b(prime|divisible|divisor|gcd|lcm|remainder|modulo|factor\w*|digit|digits|integer|arithmetic|sum of|parity|even|odd)\b",
        r"(\bgcd\b|\bpow\(|\bsqrt\b|\bmod\b|%\s*\w+|\bprime\b|\bsieve\b|\bfactor\w*|//)",
    ),
    "sorting_greedy": (
        r"\b(sort|sorted|order|greedy|arrange|rearrange|minimum number of|at most|at least|pair|pairs)\b",
        r"(\.sort\(|\bsorted\(|\bmin\(|\bmax\(|\.reverse\(|\bzip\()",
    ),
    "binary_search": (
        r"\b(binary search|monotonic|largest possible|smallest possible|k-?th|at least k)\b",
        r"(\bbisect\w*|\blo\b.*\bhi\b|\bmid\b|\blow\b.*\bhigh\b)",
    ),
    "bits": (
        r"\b(xor|bitwise|binary representation|bit|bits|and of|or of)\b",
        r"(\^|<<|>>|\bbin\(|&\s*\w|\bbit\w*)",
    ),
    "geometry": (
        r"\b(point|points|coordinate|coordinates|distance|circle|polygon|rectangle|angle|area|segment|line)\b",
        r"(\bhypot\b|\batan2?\b|\bsqrt\b|\bmath\.|\bcross\b|\bdot\b)",
    ),
    "grid": (
        r"\b(grid|matrix|cell|cells|rows?|columns?|chessboard|board|table)\b",
        r"(\bgrid\b|\bmatrix\b|\[\[|for\s+\w+\s+in\s+range\(\w+\):\s*\n\s*for\s+\w+\s+in\s+range\(\w+\))",
    ),
    "counting": (
        r"\b(permutation|permutations|combination|combinations|binomial|arrangements?|number of ways|count the number)\b",
        r"(\bfact\b|\bfactorial\b|\bcomb\b|\bchoose\b|\bcounter\b|\bdefaultdict\b|\bnCr\b)",
    ),
    "data_structure": (
        r"\b(queue|stack|heap|priority|set|dictionary|segment tree|fenwick|prefix sum|sliding window|two pointers)\b",
        r"(\bheapq\b|\bdeque\b|\bCounter\b|\bdefaultdict\b|\bbisect\b|\bSegmentTree\b|\bBIT\b|\bprefix\b|\bstack\b)",
    ),
    "multi_test": (
        r"\b(test cases?|queries)\b",
        r"(for\s+_\s+in\s+range\(int\(input\(\)\)\)|for\s+\w+\s+in\s+range\(t\)|while\s+t\b|\bt\s*=\s*int\()",
    ),
}
TOPIC_NAMES = list(TOPICS)

JS_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
PY_EXTENSIONS = [".py"]
SKIPPED_PARTS = ["node_modules", ".git"]
#: A line that opens a JavaScript function, arrow function, class or method; group 1 is its name.
JS_HEADERS = [
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b[^(]*)?\(?[^)=]*\)?\s*=>?\s*\{?",
    r"^\s*(?:export\s+)?class\s+([A-Za-z_$][\w$]*)",
    r"^\s*(?:async\s+)?(?:static\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{\s*$",
]
JS_NOT_NAMES = ["if", "for", "while", "switch", "catch", "function", "return"]

#: Encoder presets.
PRESETS = {
    "gte-modernbert-base": {"model_name": "Alibaba-NLP/gte-modernbert-base"},
    "bge-base": {"model_name": "BAAI/bge-base-en-v1.5", "query_prefix": "Represent this sentence for searching relevant passages: "},
    "bge-small": {"model_name": "BAAI/bge-small-en-v1.5", "query_prefix": "Represent this sentence for searching relevant passages: "},
    "e5-base": {"model_name": "intfloat/e5-base-v2", "query_prefix": "query: ", "doc_prefix": "passage: "},
    "minilm": {"model_name": "sentence-transformers/all-MiniLM-L6-v2", "max_seq_length": 256},
    "coderank": {"model_name": "nomic-ai/CodeRankEmbed", "query_prefix": "Represent this query for searching relevant code: ", "trust_remote_code": True},
    "hashing": {"model_name": "hashing"},
}
# ---- End of the fixed values. ----
