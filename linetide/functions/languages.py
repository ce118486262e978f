"""Languages: their matchers and delimiters, and the registry that resolves names, extensions and shebangs."""

from __future__ import annotations

from dataclasses import dataclass, field

Pair = tuple[str, str]


@dataclass(frozen=True)
class Language:
    """How files of a language are found, and what starts and ends its comments and strings."""

    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    shebangs: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[Pair, ...] = ()
    quotes: tuple[Pair, ...] = ()
    multi: tuple[Pair, ...] = ()
    raw: tuple[Pair, ...] = ()
    nested: bool = False

    def validate(self) -> None:
        """Refuses definitions that could never match or never end."""
        if not self.name:
            raise ValueError("language with empty name")
        if not (self.extensions or self.filenames or self.shebangs):
            raise ValueError(f'language "{self.name}" has no extensions, filenames, or shebangs')
        if any(not a or not b for a, b in self.block):
            raise ValueError(f'language "{self.name}" has a block comment with an empty delimiter')

    @property
    def plain(self) -> bool:
        """Whether every line that is not blank is code."""
        return not (self.line or self.block or self.quotes or self.multi or self.raw)


def _language(name: str, extensions: str = "", filenames: str = "", shebangs: str = "", **delimiters) -> Language:
    nested = delimiters.pop("nested", False)
    return Language(name, tuple(extensions.split()), tuple(filenames.split()), tuple(shebangs.split()), nested=nested, **{k: tuple(v) for k, v in delimiters.items()})


# The languages with their matchers and delimiters.
C_BLOCK, MARKUP = ("/*", "*/"), ("<!--", "-->")
DOUBLE, SINGLE, BACKTICK = ('"', '"'), ("'", "'"), ("`", "`")
TRIPLE_DOUBLE, TRIPLE_SINGLE = ('"""', '"""'), ("'''", "'''")
BUILTIN = [
    _language("ASN.1", extensions="asn asn1", line=['--'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Assembly", extensions="s asm", line=[';', '#', '//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Autoconf", extensions="in", filenames="configure.ac configure.in", line=['dnl', '#'], quotes=[DOUBLE, SINGLE]),
    _language("Automake", extensions="am", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("AWK", extensions="awk", shebangs="awk gawk mawk nawk", line=['#'], quotes=[DOUBLE]),
    _language("Bazel", extensions="bzl bazel bzlmod", filenames="BUILD BUILD.bazel MODULE.bazel WORKSPACE WORKSPACE.bazel", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("Batch", extensions="bat btm cmd", line=['::', 'REM ', 'rem ', '@REM ', '@rem ']),
    _language("C", extensions="c h inc ec pgc", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("C#", extensions="cs csx", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("C++", extensions="cpp cc cxx c++ pcc tpp hpp hh hxx ipp inl ino", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("CMake", extensions="cmake", filenames="CMakeLists.txt", line=['#'], block=[('#[[', ']]')], quotes=[DOUBLE]),
    _language("CSS", extensions="css", block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Clojure", extensions="clj cljs cljc edn", line=[';'], quotes=[DOUBLE]),
    _language("D", extensions="d", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Dart", extensions="dart", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("Device Tree", extensions="dts dtsi", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Dockerfile", extensions="dockerfile dockerignore", filenames="Dockerfile Containerfile", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Elixir", extensions="ex exs", shebangs="elixir", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE]),
    _language("Erlang", extensions="erl hrl", line=['%'], quotes=[DOUBLE]),
    _language("F#", extensions="fs fsi fsx fsscript", line=['//'], block=[('(*', '*)')], quotes=[DOUBLE], nested=True),
    _language("Fortran", extensions="f for ftn f77 pfo f90 f95 f03 f08 fpp", line=['!'], quotes=[DOUBLE, SINGLE]),
    _language("Gherkin", extensions="feature", line=['#']),
    _language("Gettext Catalog", extensions="po pot", line=['#'], quotes=[DOUBLE]),
    _language("GraphQL", extensions="graphql gql", line=['#'], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE]),
    _language("Go", extensions="go", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE], raw=[BACKTICK]),
    _language("Groovy", extensions="groovy gradle grt gtpl gvy", filenames="Jenkinsfile", shebangs="groovy", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("HCL", extensions="tf tfvars hcl", line=['#', '//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("HTML", extensions="html htm xhtml", block=[MARKUP], quotes=[DOUBLE, SINGLE]),
    _language("Intel HEX", extensions="hex"),
    _language("Haskell", extensions="hs lhs", line=['--'], block=[('{-', '-}')], quotes=[DOUBLE], nested=True),
    _language("INI", extensions="ini cfg", line=[';', '#']),
    _language("JSON", extensions="json geojson", quotes=[DOUBLE]),
    _language("Java", extensions="java", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE]),
    _language("JavaScript", extensions="js mjs cjs jsx", shebangs="node nodejs deno bun", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE], raw=[BACKTICK]),
    _language("Julia", extensions="jl", shebangs="julia", line=['#'], block=[('#=', '=#')], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE], nested=True),
    _language("Kotlin", extensions="kt kts", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE], nested=True),
    _language("LaTeX", extensions="tex sty cls", line=['%']),
    _language("Less", extensions="less", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Lex", extensions="l lex", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Linker Script", extensions="ld lds", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Lua", extensions="lua luau", shebangs="lua", line=['--'], block=[('--[[', ']]')], quotes=[DOUBLE, SINGLE]),
    _language("Makefile", extensions="mk mak", filenames="Makefile makefile GNUmakefile Build", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Markdown", extensions="md markdown", block=[MARKUP]),
    _language("Module Definition", extensions="def", line=[';'], quotes=[DOUBLE]),
    _language("Nim", extensions="nim nims", line=['#'], block=[('#[', ']#')], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE], nested=True),
    _language("OCaml", extensions="ml mli re rei", block=[('(*', '*)')], quotes=[DOUBLE], nested=True),
    _language("Objective-C", extensions="m mm", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("PHP", extensions="php php3 php4 php5 phtml", shebangs="php", line=['//', '#'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Pascal", extensions="pas pp", line=['//'], block=[('{', '}'), ('(*', '*)')], quotes=[SINGLE]),
    _language("Perl", extensions="pl pm t", shebangs="perl", line=['#'], block=[('=pod', '=cut')], quotes=[DOUBLE, SINGLE]),
    _language("PowerShell", extensions="ps1 psm1 psd1 ps1xml cdxml pssc psc1", shebangs="pwsh powershell", line=['#'], block=[('<#', '#>')], quotes=[DOUBLE, SINGLE]),
    _language("Properties", extensions="properties", line=['#', '!']),
    _language("Protobuf", extensions="proto", line=['//'], quotes=[DOUBLE]),
    _language("Python", extensions="py pyw pyi", shebangs="python", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("R", extensions="r rmd", shebangs="Rscript", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("reStructuredText", extensions="rst"),
    _language("Ruby", extensions="rb rake gemspec ru", filenames="Rakefile Gemfile Vagrantfile", shebangs="ruby", line=['#'], block=[('=begin', '=end')], quotes=[DOUBLE, SINGLE]),
    _language("Rust", extensions="rs", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], nested=True),
    _language("RPM Spec", extensions="spec", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("SCSS", extensions="scss", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("SQL", extensions="sql", line=['--'], block=[C_BLOCK], quotes=[SINGLE]),
    _language("Scala", extensions="sc scala sbt", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE]),
    _language("Shell", extensions="sh bash zsh ksh", filenames=".bashrc .zshrc .profile", shebangs="sh bash zsh ksh dash", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Svelte", extensions="svelte", line=['//'], block=[MARKUP, C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Swift", extensions="swift", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], multi=[TRIPLE_DOUBLE], nested=True),
    _language("TOML", extensions="toml", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE], raw=[TRIPLE_SINGLE]),
    _language("Plain Text", extensions="txt text"),
    _language("TypeScript", extensions="ts tsx mts cts", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE], raw=[BACKTICK]),
    _language("udev Rules", extensions="rules", line=['#'], quotes=[DOUBLE]),
    _language("UnrealScript", extensions="uc uci upkg", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Vim Script", extensions="vim", filenames=".vimrc", line=['"']),
    _language("Vue", extensions="vue", line=['//'], block=[MARKUP, C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("XML", extensions="xml xsd xsl xslt svg plist resx csproj fsproj vbproj vcproj vcxproj props targets", block=[MARKUP], quotes=[DOUBLE, SINGLE]),
    _language("YAML", extensions="yml yaml", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Yacc", extensions="y yacc", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Zig", extensions="zig", line=['//'], quotes=[DOUBLE]),
    _language("ABNF", extensions="abnf", line=[';']),
    _language("Ada", extensions="ada adb ads pad", line=['--'], quotes=[DOUBLE]),
    _language("AsciiDoc", extensions="adoc asciidoc", line=['//'], block=[('////', '////')]),
    _language("Bicep", extensions="bicep bicepparam", line=['//'], block=[C_BLOCK], quotes=[SINGLE], multi=[TRIPLE_SINGLE]),
    _language("BitBake", extensions="bb bbclass bbappend", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("C Shell", extensions="csh", shebangs="csh", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Cabal", extensions="cabal", line=['--'], block=[('{-', '-}')], nested=True),
    _language("COBOL", extensions="cob cbl ccp cobol cpy", line=['*'], quotes=[DOUBLE, SINGLE]),
    _language("CoffeeScript", extensions="coffee cjsx", line=['#'], block=[('###', '###')], quotes=[DOUBLE, SINGLE]),
    _language("Common Lisp", extensions="lisp lsp asd", line=[';'], block=[('#|', '|#')], quotes=[DOUBLE], nested=True),
    _language("Crystal", extensions="cr", shebangs="crystal", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("CUDA", extensions="cu cuh", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("CUE", extensions="cue", line=['//'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("Cython", extensions="pyx pxd pxi", shebangs="cython", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("D2", extensions="d2", line=['#'], block=[TRIPLE_DOUBLE]),
    _language("Dhall", extensions="dhall", line=['--'], block=[('{-', '-}')], quotes=[DOUBLE], raw=[("''", "''")], nested=True),
    _language("Ebuild", extensions="ebuild eclass", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Elm", extensions="elm", line=['--'], block=[('{-', '-}')], nested=True),
    _language("Emacs Lisp", extensions="el", line=[';'], quotes=[DOUBLE]),
    _language("Fennel", extensions="fnl fnlm", line=[';'], quotes=[DOUBLE]),
    _language("Fish", extensions="fish", shebangs="fish", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("FlatBuffers", extensions="fbs", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Forth", extensions="4th forth fr frt fth f83 fb fpm e4 rx ft", line=['\\'], block=[('( ', ')')]),
    _language("GDScript", extensions="gd", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("GDShader", extensions="gdshader", line=['//'], block=[C_BLOCK]),
    _language("Gleam", extensions="gleam", line=['//'], quotes=[DOUBLE]),
    _language("GLSL", extensions="vert tesc tese geom frag comp mesh task rgen rint rahit rchit rmiss rcall glsl", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Haxe", extensions="hx", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("HLSL", extensions="hlsl fx fxsub", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Jsonnet", extensions="jsonnet libsonnet", line=['//', '#'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Just", extensions="just", filenames="justfile Justfile", shebangs="just", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("LLVM", extensions="ll", line=[';'], quotes=[DOUBLE, SINGLE]),
    _language("M4", extensions="m4", line=['#', 'dnl'], quotes=[('`', "'")]),
    _language("Meson", filenames="meson.build meson_options.txt", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("Metal", extensions="metal", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Modelica", extensions="mo mos", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Nextflow", extensions="nextflow nf", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Nix", extensions="nix", line=['#'], block=[C_BLOCK], quotes=[DOUBLE], raw=[("''", "''")]),
    _language("Nushell", extensions="nu", shebangs="nu", line=['#'], quotes=[DOUBLE, SINGLE]),
    _language("Odin", extensions="odin", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Open Policy Agent", extensions="rego", line=['#'], quotes=[DOUBLE], raw=[BACKTICK]),
    _language("OpenCL", extensions="cl ocl", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("OpenSCAD", extensions="scad", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Org", extensions="org", line=['# ']),
    _language("PlantUML", extensions="puml", line=["'"], block=[("/'", "'/")], quotes=[DOUBLE]),
    _language("Processing", extensions="pde", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Prolog", extensions="p pro", line=['%'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("PureScript", extensions="purs", line=['--'], block=[('{-', '-}')], nested=True),
    _language("QML", extensions="qml", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Racket", extensions="rkt scrbl", shebangs="racket", line=[';'], block=[('#|', '|#')], quotes=[DOUBLE], nested=True),
    _language("Raku", extensions="raku rakumod rakutest pm6 pl6 p6", shebangs="raku perl6", line=['#'], block=[('#`(', ')'), ('#`[', ']'), ('#`{', '}'), ('#`｢', '｣')], quotes=[DOUBLE, SINGLE], raw=[('｢', '｣')], nested=True),
    _language("ReScript", extensions="res resi", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Roc", extensions="roc", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE]),
    _language("Sass", extensions="sass", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Scheme", extensions="scm ss", line=[';'], block=[('#|', '|#')], quotes=[DOUBLE], nested=True),
    _language("ShaderLab", extensions="shader cginc", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Snakemake", extensions="smk", filenames="Snakefile snakefile", line=['#'], quotes=[DOUBLE, SINGLE], multi=[TRIPLE_DOUBLE, TRIPLE_SINGLE]),
    _language("Solidity", extensions="sol", line=['//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Stan", extensions="stan", line=['//', '#'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Standard ML", extensions="sml", block=[('(*', '*)')], quotes=[DOUBLE], nested=True),
    _language("Stata", extensions="do", line=['//', '*'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("SystemVerilog", extensions="sv svh", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("TCL", extensions="tcl", shebangs="tclsh wish", line=['#'], quotes=[DOUBLE]),
    _language("Thrift", extensions="thrift", line=['#', '//'], block=[C_BLOCK], quotes=[DOUBLE, SINGLE]),
    _language("Typst", extensions="typ", line=['//'], block=[C_BLOCK], quotes=[DOUBLE], nested=True),
    _language("Vala", extensions="vala", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("VB6/VBA", extensions="frm bas ctl dsr", line=["'", 'REM ', 'Rem ', 'rem '], quotes=[DOUBLE]),
    _language("VBScript", extensions="vbs", line=["'", 'REM ', 'Rem ', 'rem '], quotes=[DOUBLE]),
    _language("Verilog", extensions="v vg vh", line=['//'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("VHDL", extensions="vhd vhdl", line=['--'], block=[C_BLOCK], quotes=[DOUBLE]),
    _language("Visual Basic", extensions="vb", line=["'"], quotes=[DOUBLE]),
    _language("Visual Studio Solution", extensions="sln"),
    _language("WebAssembly", extensions="wat wast", line=[';;'], block=[('(;', ';)')], quotes=[DOUBLE], nested=True),
    _language("WGSL", extensions="wgsl", line=['//'], block=[C_BLOCK], nested=True),
    _language("XAML", extensions="xaml axaml", block=[MARKUP], quotes=[DOUBLE, SINGLE]),]


def fold(extension: str) -> str:
    """An extension as the registry stores it: short ASCII ones fold A-Z only, longer ones are lower-cased."""
    return extension.lower()


@dataclass
class Registry:
    """Languages by name, and who owns each extension, file name and shebang.

    A definition of a known name replaces it and frees what it owned; a later definition takes
    over what an earlier one owns.
    """

    languages: dict[str, Language] = field(default_factory=dict)
    by_extension: dict[str, str] = field(default_factory=dict)
    by_filename: dict[str, str] = field(default_factory=dict)
    by_shebang: dict[str, str] = field(default_factory=dict)

    @classmethod
    def builtin(cls) -> Registry:
        out = cls()
        for x in BUILTIN:
            out.add(x)
        return out

    def add(self, language: Language) -> None:
        if language.name in self.languages:
            for owned in (self.by_extension, self.by_filename, self.by_shebang):
                for key in [k for k, v in owned.items() if v == language.name]:
                    del owned[key]
        self.languages[language.name] = language
        self.by_extension |= {fold(x): language.name for x in language.extensions}
        self.by_filename |= dict.fromkeys(language.filenames, language.name)
        self.by_shebang |= dict.fromkeys(language.shebangs, language.name)

    def get(self, name: str) -> Language | None:
        """A language by its name in any case; the exact name first."""
        return self.languages.get(name) or next((x for n, x in sorted(self.languages.items()) if n.casefold() == name.casefold()), None)

    def names(self) -> list[str]:
        return sorted(self.languages, key=str.encode)

    def by_path(self, path: str) -> str | None:
        """The language of a path: its exact file name, else what follows the last dot, in any case."""
        base = path.rstrip("/").rpartition("/")[2]
        found = self.by_filename.get(base)
        if found is None and "." in base:
            extension = base.rpartition(".")[2]
            found = self.by_extension.get(fold(extension)) if extension.isascii() or len(extension.encode()) > 8 else None
        return found
