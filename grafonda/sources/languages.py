"""Languages of source trees: how files are told apart, and patterns for what they define, import, inherit and call.

Patterns stand in for parsers. Each language has its extensions or file names, the marks of its line comments, and patterns with the groups
`name` and, where an entity belongs to another one, `owner`; `base` names what it inherits from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|partial|async|virtual|export|default|inline|data|suspend|external|extern|unsafe|pub|const|mut)\s+)*"


@dataclass(frozen=True)
class Language:
    extensions: str
    entities: tuple[tuple[str, str], ...]
    imports: str = ""
    names: str = ""  # whole file names, or beginnings that a dot follows
    comment: str = "//"
    calls: bool = False
    heritage: str = ""
    words: frozenset[str] = field(default=frozenset())


def _c_like(function: str = "", heritage: str = r":\s*(?P<base>[\w.<>, ]+)", **more) -> tuple[tuple[str, str], ...]:
    out = (("struct", rf"(?m)^\s*{_MODIFIERS}(?:class|struct|record|enum|object) (?P<name>\w+)"), ("interface", rf"(?m)^\s*{_MODIFIERS}(?:interface|trait|protocol) (?P<name>\w+)"))
    return (*out, *((("function", function),) if function else ()))


_KEY = r"(?m)^(?P<name>[A-Za-z_][\w.-]*)\s*[:=]"
_DEF = r"(?m)^\s*def (?:self\.)?(?P<name>\w+[?!]?)"
LANGUAGES: dict[str, Language] = {
    "bash": Language("sh bash zsh", (("function", r"(?m)^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{"), ("function", r"(?m)^\s*function\s+(?P<name>[\w-]+)\s*\{")), r"(?m)^\s*(?:source|\.)\s+(?P<path>\S+)", comment="#"),
    "bicep": Language("bicep", (("resource", r"(?m)^\s*resource (?P<name>\w+) '"), ("module", r"(?m)^\s*module (?P<name>\w+) '"), ("variable", r"(?m)^\s*(?:param|var|output) (?P<name>\w+)")), r"(?m)^\s*module \w+ '(?P<path>[^']+)'"),
    "c": Language("c h ino", (("function", r"(?m)^[A-Za-z_][\w\s*]*?\b(?P<name>\w+)\([^;{]*\)\s*\{"), ("struct", r"(?m)^\s*(?:typedef\s+)?(?:struct|enum|union) (?P<name>\w+)\s*\{")), r"""(?m)^\s*#include\s+[<"](?P<path>[^>"]+)""", calls=True),
    "clojure": Language("clj cljs cljc edn", (("function", r"(?m)^\s*\(defn-? (?:\^\S+ )*(?P<name>[^\s\[]+)"), ("interface", r"(?m)^\s*\(defprotocol (?P<name>\S+)"), ("struct", r"(?m)^\s*\((?:defrecord|deftype) (?P<name>\S+)"), ("variable", r"(?m)^\s*\(def (?P<name>\S+)")), r"\[(?P<path>[\w.-]+) :(?:as|refer)", comment=";"),
    "cmake": Language("cmake", (("function", r"(?im)^\s*(?:function|macro)\s*\(\s*(?P<name>\w+)"), ("target", r"(?im)^\s*add_(?:library|executable)\s*\(\s*(?P<name>[\w-]+)")), r"(?im)^\s*(?:include|find_package|add_subdirectory)\s*\(\s*(?P<path>[\w./-]+)", "CMakeLists.txt", "#"),
    "cpp": Language("cpp cc cxx hpp hh hxx mm", (("method", r"(?m)^[A-Za-z_][\w\s*&<>:]*?\b(?P<owner>\w+)::(?P<name>~?\w+)\([^;{]*\)[^;{]*\{"), ("function", r"(?m)^[A-Za-z_][\w\s*&<>]*?\b(?P<name>\w+)\([^;{]*\)\s*\{"), ("struct", r"(?m)^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?: class)?) (?P<name>\w+)[^;]*?\{")), r"""(?m)^\s*#include\s+[<"](?P<path>[^>"]+)""", calls=True, heritage=r"(?:class|struct) (?P<name>\w+)\s*(?:final\s*)?:\s*(?P<base>[^{]+)\{"),
    "csharp": Language("cs", (*_c_like(), ("method", rf"(?m)^\s+{_MODIFIERS}[\w<>\[\],?]+ (?P<name>\w+)\([^;]*?\)\s*(?:=>|\{{)")), r"(?m)^\s*using (?:static )?(?P<path>[\w.]+);", calls=True, heritage=r"(?:class|struct|interface|record) (?P<name>\w+)(?:<[^>]*>)?\s*:\s*(?P<base>[^{\n]+)"),
    "css": Language("css", (("rule", r"(?m)^\s*(?P<name>[.#][\w-]+)[^{;]*\{"), ("variable", r"(?m)^\s*(?P<name>--[\w-]+)\s*:")), r"""@import\s+(?:url\()?["'](?P<path>[^"']+)""", comment="/*"),
    "cue": Language("cue", (("struct", r"(?m)^(?P<name>#\w+)\s*:"), ("variable", r"(?m)^(?P<name>\w+)\s*:")), r"""(?m)^import\s+"(?P<path>[^"]+)"""),
    "dart": Language("dart", (*_c_like(r"(?m)^(?:[\w<>?]+ )?(?P<name>\w+)\([^;]*?\)\s*(?:async\s*)?(?:=>|\{)"), ("struct", r"(?m)^\s*(?:mixin|extension) (?P<name>\w+)")), r"""(?m)^import ['"](?P<path>[^'"]+)""", calls=True, heritage=r"class (?P<name>\w+)[^{]*?(?:extends|implements|with) (?P<base>[^{]+)\{"),
    "dockerfile": Language("dockerfile containerfile", (("stage", r"(?im)^\s*FROM\s+\S+\s+AS\s+(?P<name>\S+)"), ("variable", r"(?im)^\s*(?:ARG|ENV)\s+(?P<name>\w+)")), r"(?im)^\s*FROM\s+(?P<path>[^\s$]+)", "Dockerfile Containerfile", "#"),
    "elixir": Language("ex exs", (("struct", r"(?m)^\s*defmodule (?P<name>[\w.]+)"), ("interface", r"(?m)^\s*defprotocol (?P<name>[\w.]+)"), ("function", r"(?m)^\s*defp? (?P<name>\w+[?!]?)"), ("function", r"(?m)^\s*defmacrop? (?P<name>\w+)")), r"(?m)^\s*(?:alias|import|use|require) (?P<path>[\w.]+)", comment="#", calls=True),
    "elm": Language("elm", (("function", r"(?m)^(?P<name>[a-z]\w*)\s*:\s"), ("struct", r"(?m)^type (?:alias )?(?P<name>\w+)")), r"(?m)^import (?P<path>[\w.]+)", comment="--"),
    "erlang": Language("erl hrl", (("function", r"(?m)^(?P<name>[a-z]\w*)\([^)]*\)[^.]*?->"), ("struct", r"(?m)^-record\((?P<name>\w+)"), ("module", r"(?m)^-module\((?P<name>\w+)\)")), r"""(?m)^-(?:include|include_lib|import)\(["']?(?P<path>[\w./-]+)""", comment="%", calls=True),
    "fsharp": Language("fs fsi fsx", (("function", r"(?m)^\s*let (?:rec |inline |private )*(?P<name>\w+)(?: \S+)+ ="), ("struct", r"(?m)^\s*type (?P<name>\w+)"), ("module", r"(?m)^\s*module (?:rec )?(?P<name>[\w.]+)"), ("method", r"(?m)^\s*(?:static )?member (?:\w+\.)?(?P<name>\w+)")), r"(?m)^\s*open (?P<path>[\w.]+)"),
    "go": Language("go", (("method", r"(?m)^func \(\w+ \*?(?P<owner>\w+)(?:\[[^\]]*\])?\) (?P<name>\w+)\("), ("function", r"(?m)^func (?P<name>\w+)[\[(]"), ("struct", r"(?m)^type (?P<name>\w+)(?:\[[^\]]*\])? struct\b"), ("interface", r"(?m)^type (?P<name>\w+)(?:\[[^\]]*\])? interface\b")), r'(?m)^\s*(?:import )?(?:(?P<alias>\w+) )?"(?P<path>[\w./-]+)"\s*$', calls=True),
    "graphql": Language("graphql gql", (("struct", r"(?m)^\s*(?:extend )?(?:type|input|enum|union|scalar) (?P<name>\w+)"), ("interface", r"(?m)^\s*interface (?P<name>\w+)"), ("operation", r"(?m)^\s*(?:query|mutation|subscription|fragment) (?P<name>\w+)")), r"""#import\s+"(?P<path>[^"]+)""", comment="#", heritage=r"type (?P<name>\w+) implements (?P<base>[^{@]+)"),
    "groovy": Language("groovy gradle", (*_c_like(r"(?m)^\s*(?:def|void|static) (?P<name>\w+)\("), ("task", r"(?m)^\s*task (?P<name>\w+)")), r"(?m)^\s*import (?P<path>[\w.]+)", calls=True, heritage=r"class (?P<name>\w+)[^{]*?(?:extends|implements) (?P<base>[^{]+)\{"),
    "haskell": Language("hs lhs", (("function", r"(?m)^(?P<name>[a-z_][\w']*)\s*::"), ("struct", r"(?m)^(?:data|newtype|type) (?P<name>\w+)"), ("interface", r"(?m)^class (?:[^=>\n]*=> )?(?P<name>\w+)")), r"(?m)^import (?:qualified )?(?P<path>[\w.]+)", comment="--", heritage=r"(?m)^instance (?:[^=>\n]*=> )?(?P<base>\w+) (?P<name>\w+)"),
    "hcl": Language("hcl tfvars", (("block", r'(?m)^\s*(?P<owner>\w+) "(?P<name>[\w-]+)" \{'), ("variable", _KEY)), comment="#"),
    "java": Language("java", (*_c_like(), ("method", rf"(?m)^\s+{_MODIFIERS}(?:<[^>]+> )?[\w<>\[\],.?]+ (?P<name>\w+)\([^;{{]*\)\s*(?:throws [^{{]+)?\{{")), r"(?m)^import (?:static )?(?P<path>[\w.]+);", calls=True, heritage=r"(?:class|interface|record) (?P<name>\w+)[^{]*?(?:extends|implements) (?P<base>[^{]+)\{"),
    "javascript": Language("js jsx mjs cjs", (("function", r"(?m)^\s*(?:export )?(?:default )?(?:async )?function\*? (?P<name>\w+)"), ("struct", r"(?m)^\s*(?:export )?(?:default )?class (?P<name>\w+)"), ("function", r"(?m)^\s*(?:export )?(?:const|let|var) (?P<name>\w+) = (?:async )?(?:\([^)]*\)|\w+) =>"), ("method", r"(?m)^  (?:static |async )*(?P<name>(?!if|for|while|switch|return|catch)\w+)\([^)]*\) \{")), r"""(?m)(?:from|require\()\s*['"](?P<path>[^'"]+)['"]""", calls=True, heritage=r"class (?P<name>\w+) extends (?P<base>[\w.]+)"),
    "json": Language("json", (("key", r'(?m)^  ?"(?P<name>[^"]+)"\s*:'),), comment=""),
    "jsonnet": Language("jsonnet libsonnet", (("function", r"(?m)^\s*(?:local )?(?P<name>\w+)\([^)]*\)\s*[:=]"), ("variable", r"(?m)^\s*local (?P<name>\w+)\s*=")), r"""import(?:str)?\s+['"](?P<path>[^'"]+)"""),
    "julia": Language("jl", (("function", r"(?m)^\s*function (?P<name>[\w.!]+)"), ("struct", r"(?m)^\s*(?:mutable )?struct (?P<name>\w+)"), ("interface", r"(?m)^\s*abstract type (?P<name>\w+)"), ("function", r"(?m)^(?P<name>\w+!?)\([^)]*\)\s*="), ("module", r"(?m)^\s*module (?P<name>\w+)")), r"(?m)^\s*(?:using|import) (?P<path>[\w.]+)", comment="#", calls=True, heritage=r"struct (?P<name>\w+)\s*<:\s*(?P<base>\w+)"),
    "kotlin": Language("kt kts", (*_c_like(r"(?m)^\s*(?:\w+ )*fun (?:<[^>]+> )?(?:\w+\.)?(?P<name>\w+)"),), r"(?m)^import (?P<path>[\w.]+)", calls=True, heritage=r"(?:class|object|interface) (?P<name>\w+)[^{:\n]*(?:\([^)]*\))?\s*:\s*(?P<base>[^{\n]+)"),
    "lua": Language("lua", (("method", r"(?m)^\s*function (?P<owner>\w+)[.:](?P<name>\w+)"), ("function", r"(?m)^\s*(?:local )?function (?P<name>\w+)\(")), r"""require\s*\(?\s*["'](?P<path>[^"']+)""", comment="--", calls=True),
    "makefile": Language("mk", (("target", r"(?m)^(?P<name>[\w.%/-]+)\s*:(?!=)"), ("variable", r"(?m)^(?P<name>\w+)\s*[:?+]?=")), r"(?m)^-?include (?P<path>\S+)", "Makefile makefile GNUmakefile", "#"),
    "markdown": Language("md markdown mdx", (("section", r"(?m)^#{1,6} (?P<name>.+?)\s*$"),), r"\]\((?P<path>[^)#\s]+)", comment=""),
    "matlab": Language("", (("function", r"(?m)^\s*function (?:\[?[\w, ]*\]?\s*=\s*)?(?P<name>\w+)"), ("struct", r"(?m)^\s*classdef (?P<name>\w+)")), comment="%", calls=True, heritage=r"classdef (?P<name>\w+)\s*<\s*(?P<base>[\w&. ]+)"),
    "nix": Language("nix", (("function", r"(?m)^\s*(?P<name>[\w-]+)\s*=\s*\{?[\w, ?]*\}?:"), ("variable", r"(?m)^\s*(?P<name>[\w.-]+)\s*=")), r"import (?P<path>[\w./-]+)", comment="#"),
    "objc": Language("m", (("struct", r"(?m)^@implementation (?P<name>\w+)"), ("interface", r"(?m)^@(?:interface|protocol) (?P<name>\w+)"), ("method", r"(?m)^[-+]\s*\([^)]*\)\s*(?P<name>\w+)")), r"""(?m)^\s*#import\s+[<"](?P<path>[^>"]+)""", calls=True, heritage=r"@interface (?P<name>\w+)\s*:\s*(?P<base>\w+)"),
    "ocaml": Language("ml mli", (("function", r"(?m)^\s*let (?:rec )?(?P<name>[a-z_]\w*) "), ("struct", r"(?m)^\s*type (?:'\w+ )?(?P<name>\w+)"), ("module", r"(?m)^\s*module (?P<name>\w+)")), r"(?m)^\s*open (?P<path>[\w.]+)", comment="(*"),
    "perl": Language("pl pm t", (("function", r"(?m)^\s*sub (?P<name>\w+)"), ("module", r"(?m)^\s*package (?P<name>[\w:]+)")), r"(?m)^\s*(?:use|require) (?P<path>[\w:]+)", comment="#", calls=True, heritage=r"(?m)^\s*use (?:parent|base) (?:-norequire, )?(?:qw\()?['\"]?(?P<base>[\w:]+)"),
    "php": Language("php", (*_c_like(rf"(?m)^\s*{_MODIFIERS}function &?(?P<name>\w+)"),), r"(?m)^\s*use (?P<path>[\w\\]+)", calls=True, heritage=r"class (?P<name>\w+)[^{]*?(?:extends|implements) (?P<base>[^{]+)\{"),
    "plaintext": Language("txt rst", (("section", r"(?m)^(?P<name>[^\n=~-][^\n]*)\n[=~-]{3,}\s*$"),), comment=""),
    "powershell": Language("ps1 psm1 psd1", (("function", r"(?im)^\s*function (?P<name>[\w-]+)"), ("struct", r"(?im)^\s*class (?P<name>\w+)")), r"(?im)^\s*(?:Import-Module|using module) (?P<path>[\w./-]+)", comment="#", heritage=r"class (?P<name>\w+)\s*:\s*(?P<base>\w+)"),
    "protobuf": Language("proto", (("struct", r"(?m)^\s*(?:message|enum) (?P<name>\w+)"), ("interface", r"(?m)^\s*service (?P<name>\w+)"), ("method", r"(?m)^\s*rpc (?P<name>\w+)")), r"""(?m)^import (?:public )?"(?P<path>[^"]+)"""),
    "python": Language("py pyi", (("struct", r"(?m)^[ \t]*class (?P<name>\w+)"), ("function", r"(?m)^(?:async )?def (?P<name>\w+)\("), ("method", r"(?m)^[ \t]+(?:async )?def (?P<name>\w+)\((?:self|cls)\b")), r"(?m)^\s*(?:from (?P<path>[\w.]+) import|import (?P<alias>[\w.]+))", comment="#", calls=True, heritage=r"class (?P<name>\w+)\((?P<base>[^)]+)\)"),
    "r": Language("r", (("function", r"(?m)^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\("),), r"""(?m)(?:library|require|source)\(["']?(?P<path>[\w./]+)""", comment="#", calls=True),
    "ruby": Language("rb rbi rbs", (("struct", r"(?m)^\s*(?:class|module) (?P<name>[\w:]+)"), ("method", _DEF)), r"""(?m)^\s*require(?:_relative)? ['"](?P<path>[^'"]+)""", comment="#", calls=True, heritage=r"class (?P<name>[\w:]+)\s*<\s*(?P<base>[\w:]+)"),
    "rust": Language("rs", (("function", r"(?m)^\s*(?:pub(?:\([^)]*\))? )?(?:const |async |unsafe )*fn (?P<name>\w+)"), ("struct", r"(?m)^\s*(?:pub(?:\([^)]*\))? )?(?:struct|enum) (?P<name>\w+)"), ("interface", r"(?m)^\s*(?:pub(?:\([^)]*\))? )?trait (?P<name>\w+)")), r"(?m)^\s*(?:pub )?use (?P<path>[\w:]+)", calls=True, heritage=r"impl(?:<[^>]*>)? (?P<base>[\w:]+)(?:<[^>]*>)? for (?P<name>\w+)"),
    "scala": Language("scala", (*_c_like(r"(?m)^\s*(?:\w+ )*def (?P<name>\w+)"),), r"(?m)^\s*import (?P<path>[\w.]+)", calls=True, heritage=r"(?:class|object|trait) (?P<name>\w+)[^{\n]*?extends (?P<base>[\w. ]+)"),
    "scss": Language("scss sass", (("function", r"(?m)^\s*@(?:mixin|function) (?P<name>[\w-]+)"), ("variable", r"(?m)^\s*(?P<name>\$[\w-]+)\s*:"), ("rule", r"(?m)^(?P<name>[.#%][\w-]+)")), r"""@(?:import|use|forward)\s+["'](?P<path>[^"']+)"""),
    "solidity": Language("sol", (("struct", r"(?m)^\s*(?:abstract )?(?:contract|library|struct|enum) (?P<name>\w+)"), ("interface", r"(?m)^\s*interface (?P<name>\w+)"), ("method", r"(?m)^\s*(?:function|modifier|event) (?P<name>\w+)")), r"""import\s+[^"']*["'](?P<path>[^"']+)""", calls=True, heritage=r"contract (?P<name>\w+) is (?P<base>[^{]+)\{"),
    "sql": Language("sql", (("struct", r"(?im)^\s*create (?:or replace )?(?:temp(?:orary)? )?(?:table|view|materialized view)(?: if not exists)? (?P<name>[\w.\"]+)"), ("function", r"(?im)^\s*create (?:or replace )?(?:function|procedure|trigger) (?P<name>[\w.\"]+)")), comment="--"),
    "starlark": Language("bzl star", (("function", r"(?m)^def (?P<name>\w+)\("), ("target", r"""(?m)^\w+\(\s*\n?\s*name\s*=\s*["'](?P<name>[^"']+)""")), r"""(?m)^load\(["'](?P<path>[^"']+)""", "BUILD WORKSPACE", "#", True),
    "svelte": Language("svelte", (("function", r"(?m)^\s*(?:export )?(?:async )?function (?P<name>\w+)"), ("variable", r"(?m)^\s*export let (?P<name>\w+)")), r"""from ['"](?P<path>[^'"]+)""", calls=True),
    "swift": Language("swift", (*_c_like(r"(?m)^\s*(?:\w+ )*func (?P<name>\w+)"), ("struct", r"(?m)^\s*(?:\w+ )*(?:actor|extension) (?P<name>\w+)")), r"(?m)^import (?P<path>\w+)", calls=True, heritage=r"(?:class|struct|enum|extension|actor) (?P<name>\w+)\s*:\s*(?P<base>[^{]+)\{"),
    "terraform": Language("tf", (("infra", r'(?m)^\s*(?:resource|data) "(?P<owner>[\w-]+)" "(?P<name>[\w-]+)"'), ("module", r'(?m)^\s*(?:module|variable|output|provider) "(?P<name>[\w-]+)"')), r'(?m)^\s*source\s*=\s*"(?P<path>[^"]+)"', comment="#"),
    "thrift": Language("thrift", (("struct", r"(?m)^\s*(?:struct|exception|union|enum|typedef \w+) (?P<name>\w+)"), ("interface", r"(?m)^\s*service (?P<name>\w+)"), ("method", r"(?m)^\s+(?:oneway )?[\w<>,. ]+ (?P<name>\w+)\([^)]*\)")), r"""(?m)^include "(?P<path>[^"]+)""", heritage=r"service (?P<name>\w+) extends (?P<base>[\w.]+)"),
    "toml": Language("toml", (("section", r"(?m)^\[\[?(?P<name>[\w.\"-]+)\]"), ("key", _KEY)), comment="#"),
    "typescript": Language("ts tsx", (("function", r"(?m)^\s*(?:export )?(?:default )?(?:async )?function\*? (?P<name>\w+)"), ("struct", r"(?m)^\s*(?:export )?(?:default )?(?:abstract )?(?:class|enum) (?P<name>\w+)"), ("interface", r"(?m)^\s*(?:export )?(?:interface|type) (?P<name>\w+)"), ("function", r"(?m)^\s*(?:export )?const (?P<name>\w+)(?::[^=]+)? = (?:async )?(?:\([^)]*\)|\w+)(?::[^=]+)? =>"), ("method", r"(?m)^  (?:public |private |protected |static |async |readonly )*(?P<name>(?!if|for|while|switch|return|catch)\w+)\([^)]*\)(?::[^{]+)? \{")), r"""(?m)(?:from|require\()\s*['"](?P<path>[^'"]+)['"]""", calls=True, heritage=r"(?:class|interface) (?P<name>\w+)[^{]*?(?:extends|implements) (?P<base>[^{]+)\{"),
    "vue": Language("vue", (("function", r"(?m)^\s*(?:async )?function (?P<name>\w+)"), ("variable", r"(?m)^\s*const (?P<name>\w+) ="), ("component", r"name:\s*['\"](?P<name>[\w-]+)")), r"""from ['"](?P<path>[^'"]+)""", calls=True),
    "xml": Language("xml", (("element", r"""<\w[\w:.-]*\s[^>]*?\b(?:id|name)\s*=\s*["'](?P<name>[^"']+)"""),), comment=""),
    "yaml": Language("yaml yml", (("key", r"(?m)^(?P<name>[A-Za-z_][\w.-]*)\s*:"),), comment="#"),
    "zig": Language("zig", (("function", r"(?m)^\s*(?:pub |export |inline )*fn (?P<name>\w+)"), ("struct", r"(?m)^\s*(?:pub )?const (?P<name>\w+) = (?:packed |extern )?(?:struct|enum|union)")), r"""@import\("(?P<path>[^"]+)""", calls=True),
}
#: Words that stand before a parenthesis without being called.
NO_CALLS = frozenset("if for while switch return catch func function def fn class struct interface new sizeof typeof await yield elif except with in not and or lambda match case select go defer let var const import from use super print assert".split())
_CALL = re.compile(r"(?:(?P<alias>[A-Za-z_]\w*)\.)?(?P<func>[A-Za-z_]\w*)\s*\(")


@lru_cache(maxsize=1)
def by_ending() -> tuple[dict[str, str], dict[str, str]]:
    """(language by extension, language by file name)."""
    return {e: k for k, v in LANGUAGES.items() for e in v.extensions.split()}, {n: k for k, v in LANGUAGES.items() for n in v.names.split()}


def language_of(path: str, text: str = "") -> str | None:
    """By the whole file name, then its beginning up to a dot, then its extension; ".m" and ".h" by what the text holds."""
    extensions, names = by_ending()
    base = path.rsplit("/", 1)[-1]
    found = names.get(base) or names.get(base.split(".", 1)[0] if "." in base else "") or extensions.get(base.rsplit(".", 1)[-1].lower() if "." in base else "")
    if base.endswith(".m") and not re.search(r"(?m)^\s*(@(interface|implementation|protocol|import)|#import)", text):
        return "matlab"
    if base.endswith(".h"):
        return "objc" if re.search(r"(?m)^\s*@(interface|protocol)", text) else "cpp" if re.search(r"(?m)^\s*(class \w+|namespace |template\s*<)", text) else "c"
    return found


@lru_cache(maxsize=64)
def _compiled(language: str):
    own = LANGUAGES[language]
    return tuple((kind, re.compile(p)) for kind, p in own.entities), re.compile(own.heritage) if own.heritage else None, re.compile(own.imports) if own.imports else None


def entities(language: str, text: str) -> list[tuple[str, str, int, int, str, str]]:
    """(type, name, line, place, signature, doc) of what a text defines, in order: the signature is the rest of the line, the doc the comment
    lines right above."""
    own, lines, out, seen = LANGUAGES[language], text.split("\n"), [], set()
    for kind, pattern in _compiled(language)[0]:
        for m in pattern.finditer(text):
            found = m.groupdict()
            name = f"{found['owner']}.{found['name']}" if found.get("owner") else found["name"]
            at = m.start("name")
            if (name, at) in seen:
                continue
            seen.add((name, at))
            line = text.count("\n", 0, at)
            above, k = [], line - 1
            while own.comment and k >= 0 and lines[k].strip().startswith(own.comment):
                above.insert(0, lines[k].strip().lstrip(own.comment + "/*! ").strip())
                k -= 1
            out.append((kind, name, line + 1, at, lines[line].strip()[:200], " ".join(above)))
    return sorted(out, key=lambda x: x[3])


def call_sites(language: str, text: str) -> list[tuple[str, str, str]]:
    """(caller, alias, func): calls between one function's start and the next entity's."""
    if not LANGUAGES[language].calls:
        return []
    found = entities(language, text)
    out = []
    for k, (kind, name, _, at, _, _) in enumerate(found):
        if kind in ("function", "method"):
            body = text[text.find("\n", at) if "\n" in text[at:] else at : found[k + 1][3] if k + 1 < len(found) else len(text)]
            out += [(name, m["alias"] or "", m["func"]) for m in _CALL.finditer(body) if m["func"] not in NO_CALLS]
    return list(dict.fromkeys(out))


def bases(language: str, text: str) -> list[tuple[str, str]]:
    """(type, base): what types inherit from or implement, by name."""
    pattern = _compiled(language)[1]
    if pattern is None:
        return []
    split = lambda s: [re.sub(r"<.*|\(.*", "", b).strip().split(" ")[-1] for b in re.split(r",|&|\bwith\b|\bimplements\b|\bextends\b", s)]
    return [(m.groupdict().get("name") or "", b) for m in pattern.finditer(text) for b in split(m["base"]) if re.match(r"[A-Za-z_]", b)]


def imported(language: str, text: str) -> list[tuple[str, str]]:
    """(alias, path)."""
    pattern = _compiled(language)[2]
    out = []
    for m in pattern.finditer(text) if pattern else ():
        own = m.groupdict()
        path = own.get("path") or own.get("alias") or ""
        alias = own.get("alias") if own.get("path") and own.get("alias") else re.split(r"[./:\\]", path.rstrip("/"))[-1]
        if path:
            out.append((alias, path))
    return out
