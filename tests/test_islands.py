"""Declarations with nested scopes, and with brackets and words in strings and comments."""

import pytest

from graphloom.operators import code, island

# For each language: a text, and (kind, name, type it stands in) of all types and functions, then the imports.
CASES = {
    "java": (
        'package p;\nimport java.util.List;\nimport static a.B.c;\n/* class No { } */\npublic class Outer<T extends Comparable<T>>\n    extends Base {\n  String s = "} class Fake {";\n  char c = \'}\';\n'
        "  enum Mode { ON(1) { int x() { return 1; } }, OFF }\n  @Override public List<T> get(int a) throws E { if (a > 0) { return call(a); } return null; }\n  Outer() { super(); }\n"
        "  static class Inner { void deep() { new Thread() { public void run() { } }.start(); } }\n  void last() { }\n}\ninterface Face { int one(); }\n",
        {("class", "Outer", None), ("enum", "Mode", "Outer"), ("class", "Inner", "Outer"), ("interface", "Face", None), ("method", "get", "Outer"), ("method", "Outer", "Outer"), ("method", "deep", "Inner"), ("method", "last", "Outer"), ("method", "one", "Face")},
        ["java.util.List", "a.B.c"],
    ),
    "csharp": (
        'using System;\nusing IO = System.IO;\nnamespace N.M {\n  public class A : B, IC {\n    string s = @"} "" class X {";\n    public int P { get; set; }\n    public int Add(int a, int b) => a + b;\n    async Task<int> Go<T>() where T : new() { await F(); return 1; }\n    struct In { void M() { } }\n  }\n  enum E { X }\n}\n',
        {("namespace", "N.M", None), ("class", "A", None), ("struct", "In", "A"), ("enum", "E", None), ("method", "Add", "A"), ("method", "M", "In")},
        ["System", "IO = System.IO"],
    ),
    "rust": (
        "use std::{fs, io};\npub use a::b::C;\n/* outer /* fn no() {} */ fn nor() {} */\npub struct P<'a> { x: &'a str }\nstruct U;\nenum E { A { y: i32 }, B }\ntrait T { fn run(&self); fn dflt(&self) -> i32 { 1 } }\n"
        'impl<\'a> T for P<\'a> { fn run(&self) { println!("}} fn fake() {{"); help(\'}\') } }\nimpl P<\'_> { pub async fn own<F>(f: F) where F: Fn() { f() } }\nfn help(c: char) -> Result<(), E> { let r = r#"fn raw() {"#; Ok(()) }\nmod inner { pub fn leaf() {} }\n',
        {("struct", "P", None), ("struct", "U", None), ("enum", "E", None), ("trait", "T", None), ("module", "inner", None), ("method", "run", "T"), ("method", "dflt", "T"), ("method", "run", "P"), ("method", "own", "P"), ("function", "help", None), ("function", "leaf", None)},
        ["std::{fs, io}", "pub use a::b::C"],
    ),
    "go": (
        'package m\nimport (\n\t"fmt"\n\tx "net/http"\n)\ntype (\n\tS struct { a int }\n\tI interface { Run() }\n)\ntype N int\nfunc (s *S) Run() { go func() { fmt.Println("}") }() }\nfunc Map[K any](k K) { s := `func no() {`; _ = s; Other() }\nfunc Other() {}\n',
        {("struct", "S", None), ("interface", "I", None), ("struct", "N", None), ("method", "Run", "S"), ("function", "Map", None), ("function", "Other", None)},
        ["fmt", "net/http"],
    ),
    "javascript": (
        "import D, { a as b, c } from './m';\nimport * as ns from \"n\";\nimport 'side';\nconst q = require('r');\n// class No {\nexport default class A extends B {\n  constructor() { super(); }\n  static async get(x) { return `} ${x} class {`; }\n  *gen() { yield /[}\"]/g; }\n}\n"
        "function* g() {}\nconst arrow = async (x) => { if (x) { g(); } };\nlet short = x => x + 1;\nexport function f() { function hidden() {} return new A(); }\n",
        {("class", "A", None), ("method", "constructor", "A"), ("method", "get", "A"), ("method", "gen", "A"), ("function", "g", None), ("function", "arrow", None), ("function", "short", None), ("function", "f", None)},
        ["./m/D", "./m/a", "./m/c", "n", "side", "r"],
    ),
    "typescript": (
        "import type { X } from 'x';\nexport interface I { m(): void }\nenum E { A = '}' }\nabstract class G<T> implements I {\n  private f: () => void;\n  m(): void { h(); }\n  get<K>(k: K): Map<string, K> { return null; }\n}\nconst h = (a: number): number => { return a; };\n",
        {("interface", "I", None), ("enum", "E", None), ("class", "G", None), ("method", "m", "G"), ("function", "h", None)},
        ["x/X"],
    ),
    "cpp": (
        '#include <vector>\n#include "a.h"\nnamespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x), y_{1} { init(); }\n  ~A() {}\n  int get() const override { return x_; }\n  struct In { void go() {} };\n};\n}\nint A::set(int v) { if (v) { return 1; } return \'}\'; }\ntemplate <typename T> T max2(T a, T b) { return a > b ? a : b; }\nstatic const char *s = R"(} class X {)";\nint decl(int);\n',
        {("namespace", "n", None), ("class", "A", None), ("struct", "In", "A"), ("method", "A", "A"), ("method", "get", "A"), ("method", "go", "In"), ("method", "set", "A"), ("function", "max2", None)},
        ["vector", "a.h"],
    ),
    "c": (
        '#include <stdio.h>\nstruct P { int x; };\ntypedef struct { int y; } Q;\nenum E { A };\nstruct P make(int a) { struct P p = { a }; return p; }\nstatic inline int *help(void)\n{ char c = \'"\'; /* } */ return 0; }\nint main(void) { help(); for (;;) { make(1); } }\n',
        {("struct", "P", None), ("enum", "E", None), ("function", "make", None), ("function", "help", None), ("function", "main", None)},
        ["stdio.h"],
    ),
    "ruby": (
        "require 'set'\nrequire_relative \"lib/x\"\nmodule M\n  class A < B\n    def go(x)\n      return 1 if x\n      [1].each do |i|\n        while i do i -= 1 end\n      end\n      help\n    end\n    def self.make = new\n    def ok?; true; end\n  end\nend\n=begin\nclass No\n=end\ndef top\n  x = <<~SQL\n    class Fake\n  SQL\n  \"end\"\nend\n",
        {("module", "M", None), ("class", "A", "M"), ("method", "go", "A"), ("method", "make", "A"), ("method", "ok?", "A"), ("function", "top", None)},
        ["set", "lib/x"],
    ),
    "kotlin": (
        'import a.b.C\nimport a.D as E\ndata class P(val x: Int)\nclass A : B() {\n  fun go() = help(1)\n  companion object { fun make(): A { return A() } }\n  val s = """ } fun no() { """\n}\ninterface I { fun f() }\nfun <T> String.ext(t: T): Int {\n  return "}".length\n}\nfun help(x: Int) =\n  x + 1\nobject O\n',
        {("class", "P", None), ("class", "A", None), ("interface", "I", None), ("class", "O", None), ("method", "go", "A"), ("method", "f", "I"), ("function", "ext", None), ("function", "help", None)},
        ["a.b.C", "a.D"],
    ),
    "swift": ('import UIKit\nprotocol P { func f() }\nstruct S: P { func f() { print("}") } }\nextension S { func g() -> Int { let h = { 1 }; return h() } }\nfunc top() {}\n', {("interface", "P", None), ("struct", "S", None), ("class", "S", None), ("method", "f", "P"), ("method", "f", "S"), ("method", "g", "S"), ("function", "top", None)}, ["UIKit"]),
    "scala": ('import a.{B, C}\ntrait T { def f: Int }\nobject O extends T {\n  def f = g(1)\n  def g(x: Int): Int = { x + "}".length }\n}\n', {("trait", "T", None), ("class", "O", None), ("method", "f", "T"), ("method", "f", "O"), ("method", "g", "O")}, ["a.{B, C}"]),
    "php": ('<?php\nuse A\\B;\nrequire "x.php";\nclass C { public function go() { return "} class X {"; } # function no() {\n}\nfunction top() { $f = function () { }; }\n', {("class", "C", None), ("method", "go", "C"), ("function", "top", None)}, ["A\\B", "x.php"]),
    "lua": ('local m = require("mod")\n--[[ function no() ]]\nfunction m.go(x)\n  if x then return "end" end\n  for i = 1, 2 do help() end\nend\nlocal function help() end\n', {("function", "go", None), ("function", "help", None)}, ["mod"]),
    "elixir": ('defmodule A.B do\n  alias X.Y\n  def go(x) do\n    if x, do: "end", else: help(x)\n  end\n  defp help(x), do: x\nend\n', {("module", "A.B", None), ("method", "go", "A.B"), ("method", "help", "A.B")}, []),
    "julia": ('using A, B\nimport C: d\nmodule M\nstruct P\n  x\nend\nfunction go(x)\n  [i for i in x if i > 1]\n  if x "end" end\nend\nend\n', {("module", "M", None), ("struct", "P", None), ("function", "go", None)}, ["A", "B", "C"]),
    "dart": ("import 'package:a/b.dart' as b;\npart 'c.dart';\nclass A extends B {\n  int get x => 1;\n  void go() { print('}'); }\n  A(this.y);\n}\nvoid main() { A(); }\n", {("class", "A", None), ("method", "go", "A"), ("function", "main", None)}, ["package:a/b.dart", "c.dart"]),
    "powershell": ("Import-Module Foo\n<# function No { } #>\nfunction Get-It { param($x) Write-Host \"}\" }\nclass K { [int] Go() { return 1 } }\n", {("function", "Get-It", None), ("class", "K", None), ("method", "Go", "K")}, ["Foo"]),
    "zig": ('const std = @import("std");\npub fn main() void { help(); }\nfn help() void {}\n', {("function", "main", None), ("function", "help", None)}, ["std"]),
    "python": ('import os, sys as s\nfrom a.b import (c, d as e)\nclass A(B):\n    """class No:"""\n    def go(self,\n           x):\n        return help(x)\n\n    class In:\n        def deep(self): pass\nasync def help(x): return x\nbroken = = 1\n', {("class", "A", None), ("class", "In", "A"), ("method", "go", "A"), ("method", "deep", "In"), ("function", "help", None)}, ["os", "sys", "a.b.c", "a.b.d"]),
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    text, want, imports = CASES[language]
    found = island.declarations(text, language)
    assert {(f.kind, f.name, f.inside) for f in found if f.what in ("type", "function")} == want
    assert [f.name for f in found if f.what == "import"] == imports


@pytest.mark.parametrize("language", CASES)
def test_bodies_end_where_their_brackets_do(language):
    for f in island.declarations(CASES[language][0], language):
        if f.what == "function":
            assert "class" not in f.body and "fake" not in f.body.lower() and f.body.count("{") == f.body.count("}")


@pytest.mark.parametrize("language", CASES)
def test_any_prefix_is_read(language):
    text = CASES[language][0]
    for n in range(0, len(text), 3):
        island.declarations(text[:n], language)
        island.declarations(text[n:], language)


def test_long_files_are_read_in_their_own_length():
    import time

    began = time.perf_counter()
    for language, (text, _, _) in CASES.items():
        island.declarations(text * 200, language)
    assert time.perf_counter() - began < 60


def test_methods_are_named_by_their_types():
    nodes, edges = code.extract_one("a/x.rs", CASES["rust"][0])
    ids = {n["id"]: n["label"] for n in nodes}
    e = {(x["source"], x["relation"], x["target"]) for x in edges}
    assert ids["a_x_rs_p_run"] == ".run()" and ("a_x_rs_p", "defines", "a_x_rs_p_run") in e and ("a_x_rs_p", "implements", "a_x_rs_t") in e
    assert ("a_x_rs_p_run", "calls", "a_x_rs_help") in e and ("a_x_rs_p_run", "calls", "a_x_rs_fake") not in e
    assert len({n["id"] for n in nodes}) == len(nodes) and all(x["source"] in ids and x["target"] in ids for x in edges)


def test_what_c_includes():
    text = CASES["c"][0]
    for quick, relation in ((False, "imports"), (True, "includes")):
        nodes, edges = code.extract_one("a.c", text, quick)
        assert [x["relation"] for x in edges if "import" in x["target"]] == [relation]
    kinds = lambda path, text, quick: [n["node_type"] for n in code.extract_one(path, text, quick)[0] if "_import_" in n["id"]]
    assert kinds("a.cs", "using System;\n", True) == ["namespace"] and kinds("a.cs", "using System;\n", False) == ["module"]
    assert kinds("a.go", 'import "fmt"\n', False) == ["package"]


def test_ruby_calls_need_no_brackets():
    _, edges = code.extract_one("a.rb", "class A\n  def go\n    help\n  end\n  def help\n  end\nend\n")
    assert ("a_rb_a_go", "calls", "a_rb_a_help") in {(x["source"], x["relation"], x["target"]) for x in edges}
