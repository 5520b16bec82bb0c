"""Grammars of the supported languages (notation: ``gll``).

They describe the syntax from which programs are built, not names, types or
constant values.  Where a language has dialects each has a start rule: Python 3
and 2, modules and scripts of JavaScript, C++ and C in headers (.h), JSON with
comments and with or without trailing commas.  The start rules run together,
and a text is accepted if one of them accepts it.
"""

from __future__ import annotations

import re


def dialect(text: str, mark: str, **changed: str) -> str:
    """The rules of a grammar once more, their names ending in ``mark``, with those of ``changed`` put in their place."""
    rules = dict(re.findall(r"(?m)^(\w+) = (.*?) ;$", re.sub(r"\n  +", " ", text)))
    named = lambda body: re.sub(r"'[^']*'|\b[A-Z]\w*\b", lambda m: m[0] + mark if m[0] in rules or m[0] in changed else m[0], body)
    return "".join(f"{name}{mark} = {named(body)} ;\n" for name, body in {**rules, **changed}.items())


JSON = """
Json = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | curly{Members} | brack{Items} ;
Members = ( STR ':' Value ( ',' STR ':' Value )* )? ;
Items = ( Value ( ',' Value )* )? ;
"""
#: JSON as configuration files have it; comments are left out by the lexer.
JSON_WITH_COMMENTS = JSON + dialect(JSON, "C", Members="( STR ':' Value ( ',' STR ':' Value )* ','? )?", Items="( Value ( ',' Value )* ','? )?")

#: Shared by the scripts with and without types; ``Ta`` and the Ts rules are filled in below.
_SCRIPT = """
Module = Item* ;
Item = Stmt | 'import' STR EOS | 'import' 'type'? Clause 'from' STR With? EOS | 'import' Name '=' Expr EOS | 'export' Exported ;
With = ( 'with' | 'assert' ) curly{Props} ;
Clause = Name ( ',' ( curly{Specs} | '*' 'as' Name ) )? | curly{Specs} | '*' 'as' Name ;
Specs = ( Spec ( ',' Spec )* ','? )? ;
Spec = 'type'? ( Word | STR ) ( 'as' ( Word | STR ) )? ;
Exported = 'default' ( Func | Class | Assign EOS ) | 'type'? curly{Specs} ( 'from' STR With? )? EOS | 'type'? '*' ( 'as' Word )? 'from' STR With? EOS
  | Vars EOS | Func | Class | TsDecl | '=' Expr EOS ;
Stmts = Stmt* ;
Stmt = curly{Stmts} | ';' | Vars EOS | Func | Class | 'if' paren{Expr} Stmt ( 'else' Stmt )? | 'for' 'await'? paren{ForHead} Stmt | 'while' paren{Expr} Stmt
  | 'do' Stmt 'while' paren{Expr} EOS | 'return' Expr? EOS | 'break' Name? EOS | 'continue' Name? EOS | 'throw' Expr EOS
  | 'try' curly{Stmts} ( 'catch' paren{CatchHead}? curly{Stmts} )? ( 'finally' curly{Stmts} )? | 'switch' paren{Expr} curly{Cases}
  | Sloppy | Name ':' Stmt | 'debugger' EOS | ExprStart EOS | TsDecl ;
CatchHead = Pattern Ta? ;
Cases = ( ( 'case' Expr | 'default' ) ':' Stmts )* ;
ForHead = ( Vars | Expr )? ';' Expr? ';' Expr? | ( 'var' | 'let' | 'const' | 'using' )? Pattern Ta? ( 'of' | 'in' ) Expr | Postfix ( 'of' | 'in' ) Expr ;
Vars = ( 'var' | 'let' | 'const' | 'using' ) Var ( ',' Var )* ;
Var = Pattern '!'? Ta? ( '=' Assign )? ;
Func = 'async'? 'function' '*'? Name? Tp? paren{Params} Ta? ( curly{Stmts} | TsEnd ) ;
Class = Deco* 'abstract'? 'class' Name? Tp? ( 'extends' Postfix Targs? )? ( 'implements' Types )? curly{ClassBody} ;
Deco = '@' ( Name ( '.' Word )* paren{Args}? | paren{Expr} ) ;
ClassBody = Member* ;
Member = ';' | Deco* Mod* ( ( 'get' | 'set' )? '*'? PropName '?'? Method | PropName ( '?' | '!' )? Ta? ( '=' Assign )? EOS | 'static' curly{Stmts} | brack{IndexSig} Ta EOS ) ;
Mod = 'static' | 'async' | 'readonly' | 'public' | 'private' | 'protected' | 'abstract' | 'override' | 'declare' | 'accessor' ;
IndexSig = Name ':' Type ;
Method = Tp? paren{Params} Ta? ( curly{Stmts} | TsEnd ) ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Deco* Mod* '...'? ( Pattern | 'this' ) '?'? Ta? ( '=' Assign )? ;
Pattern = Name | brack{ArrayPat} | curly{ObjectPat} ;
ArrayPat = ','* ( Target ( ','+ Target )* )? ','* ;
Target = '...'? ( Pattern | Postfix ) ( '=' Assign )? ;
ObjectPat = ( Field ( ',' Field )* ','? )? ;
Field = '...' Pattern | PropName ( ':' ( Pattern | Postfix ) )? ( '=' Assign )? ;
PropName = Word | STR | NUM | brack{Assign} ;
Elems = ','* ( Elem ( ','+ Elem )* )? ','* ;
Elem = '...'? Assign ;
Args = ( Elem ( ',' Elem )* ','? )? ;
Props = ( Prop ( ',' Prop )* ','? )? ;
Prop = '...' Assign | PropName ':' Assign | Name ( '=' Assign )? | 'async'? '*'? PropName Method | ( 'get' | 'set' ) PropName Method ;
Expr = Assign ( ',' Assign )* ;
Assign = Arrow | 'yield' '*'? Assign? | Unary ( Bin Unary )* ( '?' Assign ':' Assign | ( '=' | ASG ) Assign )? ;
ExprStart = AssignStart ( ',' Assign )* ;
AssignStart = Arrow | 'yield' '*'? Assign? | UnaryStart ( Bin Unary )* ( '?' Assign ':' Assign | ( '=' | ASG ) Assign )? ;
Arrow = 'async'? ( Name | Tp? paren{Params} Ta? ) '=>' ( Assign | curly{Stmts} ) ;
Unary = Pre* Postfix ;
UnaryStart = Pre+ Postfix | PrimStart Tail* INC? ;
Pre = ADD | UN | '!' | INC | 'typeof' | 'void' | 'delete' | 'await' | 'new' | TsCast ;
Bin = BIN | ADD | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | 'in' | 'instanceof' ;
Postfix = Prim Tail* INC? ;
Tail = '.' Word | '?.' ( Word | Targs? paren{Args} | brack{Expr} ) | brack{Expr} | paren{Args} | TEMPLATE | markup{Holes} | TsTail ;
Prim = PrimStart | curly{Props} | Func | Class ;
PrimStart = Name | NUM | STR | REGEX | TEMPLATE | markup{Holes} | 'this' | 'super' | 'null' | 'true' | 'false' | paren{Expr} | brack{Elems} | 'import' ( paren{Args} | '.' Word ) ;
Holes = curly{Hole}* ;
Hole = ( '...'? Expr )? ;
Name = ID | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'type' | 'using' | 'accessor' | 'yield' | 'let' | 'assert' | 'implements' | 'interface' | 'public' | 'private' | 'protected' | 'abstract'
  | 'readonly' | 'declare' | 'override' | 'namespace' | 'module' | 'keyof' | 'infer' | 'is' | 'satisfies' | 'unique' | 'asserts' ;
Word = Name | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function'
  | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
"""

_MODULE = _SCRIPT + """
Sloppy = NEVER ;
Ta = NEVER ;
Tp = NEVER ;
Targs = NEVER ;
Type = NEVER ;
Types = NEVER ;
TsDecl = NEVER ;
TsEnd = NEVER ;
TsCast = NEVER ;
TsTail = NEVER ;
"""
_NAMES = re.search(r"(?m)^Name = (.*?) ;$", re.sub(r"\n  +", " ", _SCRIPT))[1]
#: Modules, and scripts: these have no imports and exports, may use ``with`` and have await as a name.
JAVASCRIPT = _MODULE + dialect(_MODULE, "S", Item="Stmt", Sloppy="'with' paren{Expr} Stmt", Name=_NAMES + " | 'await'")

TYPESCRIPT = _SCRIPT + """
Sloppy = 'with' paren{Expr} Stmt ;
Ta = ':' Type | ':' 'asserts'? ( Name | 'this' ) ( 'is' Type )? ;
Tp = '<' Tparam ( ',' Tparam )* ','? '>' ;
Tparam = ( 'const' | 'in' )* Name ( 'extends' Type )? ( '=' Type )? ;
Targs = '<' Type ( ',' Type )* '>' ;
Types = Type ( ',' Type )* ;
Type = Union ( 'extends' Union '?' Type ':' Type )? | 'abstract'? 'new'? Tp? paren{Params} '=>' FnResult ;
FnResult = Type | 'asserts'? ( Name | 'this' ) 'is' Type ;
Union = ( '|' | '&' )? TypeUnary ( ( '|' | '&' ) TypeUnary )* ;
TypeUnary = ( 'keyof' | 'readonly' | 'unique' | 'infer' )* TypePrim brack{TypeIn}* ;
TypeIn = Type? ;
TypePrim = 'typeof'? Name ( '.' Word )* Targs? | STR | ADD? NUM | 'null' | 'void' | 'this' | 'true' | 'false' | TEMPLATE | markup{Holes} | paren{Type} | brack{Tuple} | curly{TypeBody} | 'import' paren{Args} ( '.' Word )* Targs? ;
Tuple = ( TupleElem ( ',' TupleElem )* ','? )? ;
TupleElem = '...'? ( Name '?'? ':' )? Type '?'? ;
TypeBody = ( TypeMember ( ',' | EOS ) )* TypeMember? ;
TypeMember = Mod* ( ADD? 'readonly' )? ( ( 'get' | 'set' )? PropName '?'? ( Ta | Tp? paren{Params} Ta? )? | brack{IndexSig} ( ADD? '?' )? Ta | brack{Mapped} ( ADD? '?' )? Ta? | 'new'? Tp? paren{Params} Ta? ) ;
Mapped = Name 'in' Type ( 'as' Type )? ;
TsDecl = 'interface' Name Tp? ( 'extends' Types )? curly{TypeBody} | 'type' Name Tp? '=' Type EOS | 'const'? 'enum' Name curly{EnumBody} | ( 'namespace' | 'module' ) ( STR | Name ( '.' Word )* ) ( curly{Module} | EOS )
  | 'declare' ( Vars EOS | Func | Class | TsDecl | Name curly{Module} ) ;
EnumBody = ( EnumItem ( ',' EnumItem )* ','? )? ;
EnumItem = PropName ( '=' Assign )? ;
TsEnd = EOS ;
TsCast = Targs ;
TsTail = '!' | ( 'as' | 'satisfies' ) Type | Targs paren{Args} | Targs ;
"""

JAVA = """
File = Item* ;
Item = Note* 'package' Path ';' | 'import' 'static'? Path ( '.' '*' )? ';' | TypeDecl | ';' | 'module' Path curly{AnyTokens} ;
Path = Name ( '.' Name )* ;
Note = '@' Path paren{NoteArgs}? ;
NoteArgs = ( ( Name '=' )? NoteValue ( ',' ( Name '=' )? NoteValue )* )? ;
NoteValue = Expr | Note | curly{NoteItems} ;
NoteItems = ( NoteValue ( ',' NoteValue )* ','? )? ;
Mod = MOD | 'default' | Note | 'static' | 'final' | 'synchronized' ;
TypeDecl = Mod* ( 'class' Name Tp? ( 'extends' Type )? ( 'implements' Types )? ( 'permits' Types )? curly{Body} | 'interface' Name Tp? ( 'extends' Types )? ( 'permits' Types )? curly{Body}
  | 'enum' Name ( 'implements' Types )? curly{EnumBody} | 'record' Name Tp? paren{Params} ( 'implements' Types )? curly{Body} | '@' 'interface' Name curly{Body} ) ;
EnumBody = ( EnumItem ( ',' EnumItem )* ','? )? ( ';' Body )? ;
EnumItem = Note* Name paren{Args}? curly{Body}? ;
Body = Member* ;
Member = ';' | TypeDecl | 'static'? curly{Stmts} | Method | Mod* Tp? Name paren{Params} Throws? curly{Stmts} | Mod* Name curly{Stmts} | Mod* Type Vars ';' ;
Method = Mod* Tp? Type Name paren{Params} Dims Throws? ( curly{Stmts} | ';' | 'default' NoteValue ';' ) ;
Throws = 'throws' Types ;
Tp = '<' Tparam ( ',' Tparam )* '>' ;
Tparam = Note* Name ( 'extends' Type ( '&' Type )* )? ;
Types = Type ( ',' Type )* ;
Type = Note* ( PRIM | Name Targs? ( '.' Note* Name Targs? )* ) Dims ;
Targs = '<' ( Targ ( ',' Targ )* )? '>' ;
Targ = Type | Note* '?' ( ( 'extends' | 'super' ) Type )? ;
Dims = ( Note* brack{Nothing} )* ;
Nothing = ;
Params = ( Param ( ',' Param )* )? ;
Param = Mod* Type Note* '...'? ( Name Dims | ( Name '.' )? 'this' ) ;
Vars = Var ( ',' Var )* ;
Var = Name Dims ( '=' Init )? ;
Init = Expr | curly{Inits} ;
Inits = ( Init ( ',' Init )* ','? )? ;
Stmts = Stmt* ;
Stmt = curly{Stmts} | ';' | Mod* Type Vars ';' | TypeDecl | Expr ';' | 'if' paren{Expr} Stmt ( 'else' Stmt )? | 'for' paren{ForHead} Stmt | 'while' paren{Expr} Stmt | 'do' Stmt 'while' paren{Expr} ';'
  | 'return' Expr? ';' | 'break' Name? ';' | 'continue' Name? ';' | 'throw' Expr ';' | 'yield' Expr ';' | 'assert' Expr ( ':' Expr )? ';' | 'synchronized' paren{Expr} curly{Stmts}
  | 'try' paren{Resources}? curly{Stmts} ( 'catch' paren{CatchHead} curly{Stmts} )* ( 'finally' curly{Stmts} )? | 'switch' paren{Expr} curly{Cases} | Name ':' Stmt ;
Resources = Resource ( ';' Resource )* ';'? ;
Resource = Mod* Type Name '=' Expr | Expr ;
CatchHead = Mod* Type ( '|' Type )* Name ;
Cases = ( Label+ Stmts | Label1 ( Expr ';' | curly{Stmts} | 'throw' Expr ';' ) )* ;
Label = ( 'case' CaseItem ( ',' CaseItem )* | 'default' ) ':' ;
Label1 = ( 'case' CaseItem ( ',' CaseItem )* | 'default' ) '->' ;
CaseItem = ( Cond | 'default' | Pattern ) ( 'when' Expr )? ;
Pattern = Mod* Type ( Name | paren{Patterns} Name? ) ;
Patterns = ( Pattern ( ',' Pattern )* )? ;
ForHead = ( Mod* Type Vars | Args )? ';' Expr? ';' Args | Mod* Type Name ':' Expr ;
Args = ( Expr ( ',' Expr )* )? ;
Expr = Lambda | Cond ( ( '=' | ASG ) Expr )? ;
Cond = Unary ( Bin Unary | 'instanceof' ( Pattern | Mod* Type ) )* ( '?' Expr ':' ( Cond | Lambda ) )? ;
Lambda = ( Name | paren{LambdaParams} ) '->' ( Expr | curly{Stmts} ) ;
LambdaParams = Params | ( Name ( ',' Name )* )? ;
Bin = BIN | ADD | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' ;
Unary = ( ADD | UN | INC | paren{CastType} )* ( Postfix | Lambda ) ;
CastType = Type ( '&' Type )* ;
Postfix = Prim Tail* INC? ;
Prim = Name | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | paren{Expr} | Type '.' 'class' | 'new' New | Name paren{Args} | 'this' paren{Args} | 'super' paren{Args} | 'switch' paren{Expr} curly{Cases} | Type '::' ( Name | 'new' ) ;
New = Targs? Type ( paren{Args} curly{Body}? | curly{Inits} ) | Note* ( PRIM | Name Targs? ( '.' Name Targs? )* ) brack{Expr}+ Dims ;
Tail = '.' ( Targs? Name paren{Args}? | 'this' | 'class' | 'new' New | Targs? 'super' paren{Args}? ) | brack{Expr} | '::' Targs? ( Name | 'new' ) ;
Name = ID | 'record' | 'module' | 'yield' | 'permits' | 'when' ;
"""

CSHARP = """
File = Item* ;
Item = 'global'? 'using' 'static'? ( Name '=' )? Type ';' | 'extern' Name Name ';' | Attr* 'namespace' Path ( curly{File} | ';' ) | Attr+ | Decl | Stmt ;
Path = Name ( '.' Name )* ;
Attr = brack{AnyTokens} ;
Mod = MOD | 'static' | 'readonly' | 'const' | 'ref' | 'async' | 'unsafe' | 'new' | 'partial' | 'required' | 'file' ;
Decl = Attr* Mod* ( ( 'class' | 'struct' | 'interface' | 'record' ( 'class' | 'struct' )? ) Name Tp? paren{Params}? ( ':' Type paren{Args}? ( ',' Type )* )? Where* ( curly{Body} | ';' ) ';'?
  | 'enum' Name ( ':' Type )? curly{EnumBody} ';'? | 'delegate' Type Name Tp? paren{Params} Where* ';' ) ;
Where = 'where' Name ':' Bound ( ',' Bound )* ;
Bound = Type | 'class' '?'? | 'struct' | 'new' paren{Nothing} | 'default' ;
EnumBody = ( EnumItem ( ',' EnumItem )* ','? )? ;
EnumItem = Attr* Name ( '=' Expr )? ;
Body = Member* ;
Member = ';' | Decl | Attr* Mod* ( Type Member1 | Name paren{Params} ( ':' ( 'base' | 'this' ) paren{Args} )? FnBody | UN Name paren{Nothing} FnBody | 'event' Type ( Vars ';' | QName curly{Accessors} )
  | ( 'implicit' | 'explicit' ) 'operator' Type paren{Params} FnBody ) ;
Member1 = Vars ';' | QName Tp? paren{Params} Where* FnBody | QName curly{Accessors} ( '=' Expr ';' )? | QName '=>' Expr ';' | ( QName '.' )? 'this' brack{Params} ( curly{Accessors} | '=>' Expr ';' ) | 'operator' OpName paren{Params} FnBody ;
OpName = ADD | UN | INC | BIN | '*' | '<' | '>' | '&' | '|' | 'true' | 'false' | '>' '>' ;
QName = Name Targs? ( '.' Name Targs? )* ;
FnBody = curly{Stmts} | '=>' Expr ';' | ';' ;
Accessors = ( Attr* Mod* ( 'get' | 'set' | 'init' | 'add' | 'remove' ) FnBody )* ;
Tp = '<' Attr* ( 'in' | 'out' )? Name ( ',' Attr* ( 'in' | 'out' )? Name )* '>' ;
Type = 'ref'? 'readonly'? ( PRIM | Name Targs? ( ( '.' | '::' ) Name Targs? )* | paren{TupleType} ) ( '?' | '*' | brack{Commas} )* ;
TupleType = Type Name? ( ',' Type Name? )+ ;
Commas = ','* ;
Targs = '<' ( Type ( ',' Type )* | ','* ) '>' ;
Nothing = ;
Params = ( Param ( ',' Param )* )? ;
Param = Attr* ( 'this' | 'ref' | 'out' | 'in' | 'params' | 'readonly' | MOD )* Type Name? ( '=' Expr )? ;
Vars = Var ( ',' Var )* ;
Var = Name ( '=' Init )? ;
Init = 'ref'? Expr | curly{Inits} ;
Inits = ( ObjInit ( ',' ObjInit )* ','? )? ;
ObjInit = Init | brack{Args} '=' Init ;
Stmts = Stmt* ;
Stmt = curly{Stmts} | ';' | ( 'const' | 'using' | 'await' | 'static' | 'readonly' )* Type Vars ';' | Attr* Mod* Type Name Tp? paren{Params} Where* FnBody | Expr ';' | 'if' paren{Expr} Stmt ( 'else' Stmt )? | 'for' paren{ForHead} Stmt
  | 'await'? 'foreach' paren{EachHead} Stmt | 'while' paren{Expr} Stmt | 'do' Stmt 'while' paren{Expr} ';' | 'return' 'ref'? Expr? ';' | 'break' ';' | 'continue' ';' | 'throw' Expr? ';' | 'goto' ( Name | 'case' Expr | 'default' ) ';'
  | 'yield' ( 'return' Expr | 'break' ) ';' | 'try' curly{Stmts} Catch* ( 'finally' curly{Stmts} )? | 'switch' paren{Expr} curly{Cases} | ( 'lock' | 'using' | 'fixed' ) paren{Using} Stmt | ( 'checked' | 'unchecked' | 'unsafe' ) curly{Stmts} | Name ':' Stmt ;
Using = Expr | Type Vars ;
Catch = 'catch' paren{CatchHead}? ( 'when' paren{Expr} )? curly{Stmts} ;
CatchHead = Type Name? ;
Cases = ( ( 'case' Pattern ( 'when' Expr )? | 'default' ) ':' Stmts )* ;
ForHead = ( Type Vars | Args )? ';' Expr? ';' Args ;
EachHead = Type Name 'in' Expr | 'var' paren{AnyTokens} 'in' Expr | paren{AnyTokens} 'in' Expr ;
Args = ( Arg ( ',' Arg )* )? ;
Arg = ( Name ':' )? ( 'ref' | 'out' | 'in' )? ( Expr | Type Name ) ;
Expr = Lambda | Query | Cond ( ( '=' | ASG ) 'ref'? Expr )? | 'throw' Expr ;
Lambda = Attr* ( 'async' | 'static' )* Type? ( Name | paren{LambdaParams} ) '=>' ( Expr | curly{Stmts} ) | ( 'async' | 'static' )* 'delegate' paren{Params}? curly{Stmts} ;
LambdaParams = Params | ( Name ( ',' Name )* )? ;
Query = 'from' Type? Name 'in' Expr QueryPart+ ;
QueryPart = 'from' Type? Name 'in' Expr | 'let' Name '=' Expr | 'where' Expr | 'join' Type? Name 'in' Expr 'on' Expr 'equals' Expr ( 'into' Name )? | 'orderby' Expr ( 'ascending' | 'descending' )? ( ',' Expr ( 'ascending' | 'descending' )? )* | 'select' Expr | 'group' Expr 'by' Expr | 'into' Name ;
Cond = Unary ( Bin Unary | 'is' Pattern | 'as' Type | 'switch' curly{Arms} | 'with' curly{Inits} )* ( '?' Expr ':' Expr )? ( '??' Expr )? ;
Arms = ( Arm ( ',' Arm )* ','? )? ;
Arm = Pattern ( 'when' Expr )? '=>' Expr ;
Pattern = 'not'? Pattern1 ( ( 'and' | 'or' ) 'not'? Pattern1 )* ;
Pattern1 = Unary ( Bin Unary )* | ( '<' | '>' | BIN ) Unary | Type Name? | 'var' ( Name | paren{AnyTokens} ) | Type? ( curly{AnyTokens} | paren{AnyTokens} ) Name? | brack{AnyTokens} Name? ;
Bin = BIN | ADD | '*' | '<' | '>' | '>' '>' | '&' | '|' | '??' ;
Unary = ( ADD | UN | INC | '!' | '&' | '*' | '^' | 'await' | paren{Type} )* Postfix ;
Postfix = Prim Tail* ( INC | '!' )* ;
Prim = Name Targs? | PRIM | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'base' | paren{TupleExpr} | 'default' paren{Type}? | ( 'typeof' | 'sizeof' | 'nameof' ) paren{AnyTokens} | ( 'checked' | 'unchecked' ) paren{Expr} | 'new' New | 'stackalloc' Type? brack{Expr} curly{Inits}? | brack{Spread} ;
Spread = ( '..'? Expr ( ',' '..'? Expr )* ','? )? ;
TupleExpr = Arg ( ',' Arg )* ;
New = Type paren{Args}? curly{Inits}? | paren{Args} curly{Inits}? | brack{Commas}+ curly{Inits} | curly{Inits} | ( PRIM | QName ) brack{Args} brack{Commas}* curly{Inits}? ;
Tail = ( '.' | '->' | '?' '.' | '::' ) Name Targs? | '?'? brack{Args} | paren{Args} | '!' | '..' Unary? ;
Name = ID | 'var' | 'get' | 'set' | 'init' | 'add' | 'remove' | 'async' | 'partial' | 'required' | 'file' | 'from' | 'where' | 'select' | 'group' | 'by' | 'into' | 'orderby' | 'join' | 'on' | 'equals' | 'let' | 'ascending' | 'descending' | 'when' | 'record' | 'yield' | 'global' | 'not' | 'and' | 'or' | 'with' | 'nameof' | 'await' ;
"""

GO = """
File = ( Item? ';' )* Item? ;
Item = 'package' ID | 'import' ( Import | paren{Imports} ) | Decl | 'func' Receiver? ID Tp? paren{Params} Result? curly{Stmts}? ;
Import = ( ID | '.' )? STR ;
Imports = ( Import? ';' )* Import? ;
Receiver = paren{Params} ;
Decl = 'var' ( VarSpec | paren{VarSpecs} ) | 'const' ( ConstSpec | paren{ConstSpecs} ) | 'type' ( TypeSpec | paren{TypeSpecs} ) ;
VarSpecs = ( VarSpec? ';' )* VarSpec? ;
VarSpec = Ids ( Type ( '=' Exprs )? | '=' Exprs ) ;
ConstSpecs = ( ConstSpec? ';' )* ConstSpec? ;
ConstSpec = Ids ( Type? '=' Exprs )? ;
TypeSpecs = ( TypeSpec? ';' )* TypeSpec? ;
TypeSpec = ID Tp? '='? Type ;
Ids = ID ( ',' ID )* ;
Tp = brack{Params} ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Ids? '...'? Constraint | Constraint ;
Constraint = UN? Type ( '|' UN? Type )* ;
Result = Type | paren{Params} ;
Type = ID ( '.' ID )? brack{TypeArgs}? | '*' Type | brack{Length} Type | 'map' brack{Type} Type | ARROW? 'chan' ARROW? Type | 'func' paren{Params} Result? | 'struct' curly{Fields} | 'interface' curly{Methods} | paren{Type} ;
TypeArgs = Type ( ',' Type )* ','? ;
Length = ( Expr | '...' )? ;
Fields = ( Field? ';' )* Field? ;
Field = ( Ids Type | '*'? ID ( '.' ID )? brack{TypeArgs}? ) STR? ;
Methods = ( MethodSpec? ';' )* MethodSpec? ;
MethodSpec = ID paren{Params} Result? | Constraint ;
Stmts = ( Stmt? ';' )* Stmt? ;
Stmt = Decl | Simple | ID ':' Stmt? | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' Expr | 'defer' Expr | curly{Stmts} | If | 'for' ForHead? curly{Stmts} | 'switch' ( ( Simple? ';' )? SwitchOn? ) curly{Cases} | 'select' curly{Cases} ;
If = 'if' ( Simple? ';' )? HExpr curly{Stmts} ( 'else' ( If | curly{Stmts} ) )? ;
SwitchOn = HExpr | ( ID DEF )? HPostfix '.' paren{Kw} ;
Kw = 'type' ;
ForHead = HExpr | HSimple? ';' HExpr? ';' HSimple? | ( Exprs ( DEF | '=' ) )? 'range' HExpr ;
Cases = ( ( 'case' ( CaseItems | Simple ) | 'default' ) ':' Stmts )* ;
CaseItems = ( Expr | Type ) ( ',' ( Expr | Type ) )* ;
Simple = Expr ( INC | ARROW Expr )? | Exprs ( DEF | '=' | ASG ) Exprs ;
HSimple = HExpr ( INC | ARROW HExpr )? | Exprs ( DEF | '=' | ASG ) HExpr ( ',' HExpr )* ;
Exprs = Expr ( ',' Expr )* ;
Expr = Unary ( Bin Unary )* ;
HExpr = HUnary ( Bin HUnary )* ;
Bin = BIN | ADD | '*' | '<' | '>' | '&' | '|' ;
Unary = ( ADD | UN | '!' | '*' | '&' | ARROW )* Postfix ;
HUnary = ( ADD | UN | '!' | '*' | '&' | ARROW )* HPostfix ;
Postfix = Prim Tail* ;
HPostfix = HPrim Tail* ;
Prim = HPrim | LitType curly{Elems} ;
HPrim = ID | NUM | STR | CHAR | paren{ExprOrType} | 'func' paren{Params} Result? curly{Stmts} | brack{Length} Type curly{Elems}? | 'map' brack{Type} Type curly{Elems}? | 'struct' curly{Fields} curly{Elems}? | 'chan' Type | 'interface' curly{Methods} ;
ExprOrType = Expr | Type ;
LitType = ID ( '.' ID )? brack{TypeArgs}? ;
Elems = ( Elem ( ',' Elem )* ','? )? ;
Elem = ( Value ':' )? Value ;
Value = Expr | curly{Elems} ;
Tail = '.' ( ID | paren{TypeOrKw} ) | brack{Index} | paren{Args} | DotLit ;
DotLit = NEVER ;
TypeOrKw = Type | 'type' ;
Index = Expr? ( ':' Expr? )* | TypeArgs ;
Args = ( Arg ( ',' Arg )* '...'? ','? )? ;
Arg = Expr '...'? | Type ;
"""

RUST = """
File = Item* ;
Item = Attr* Vis? ( 'use' UseTree ';' | 'extern' 'crate' Name ( 'as' Name )? ';' | 'mod' Name ( ';' | curly{File} ) | Fn | 'unsafe'? 'extern' STR? curly{File} | ( 'const' | 'static' ) 'mut'? Name ':' Type ( '=' Expr )? ';'
  | 'type' Name Tp? ( ':' Bounds )? Where? ( '=' Type )? ';' | 'struct' Name Tp? ( Where? curly{Fields} | paren{TupleFields} Where? ';' | ';' ) | 'union' Name Tp? curly{Fields} | 'enum' Name Tp? Where? curly{Variants}
  | 'unsafe'? 'auto'? 'trait' Name Tp? ( ':' Bounds? )? Where? curly{File} | 'unsafe'? 'impl' Tp? 'const'? ( '!'? Type 'for' )? Type Where? curly{File} | Macro ';'? | Name '!' Name curly{AnyTokens} ) | Attr | ';' ;
Attr = '#' '!'? brack{AnyTokens} ;
Vis = 'pub' paren{AnyTokens}? | 'crate' ;
UseTree = '::'? ( Seg '::' )* ( Seg ( 'as' ( Name | '_' ) )? | '*' | curly{UseTrees} ) ;
UseTrees = ( UseTree ( ',' UseTree )* ','? )? ;
Seg = Name | 'self' | 'super' | 'crate' | 'Self' ;
Fn = ( 'const' | 'async' | 'unsafe' | 'extern' STR? | 'default' )* 'fn' Name Tp? paren{Params} ( '->' Type )? Where? ( curly{Block} | ';' ) ;
Tp = '<' ( Tparam ( ',' Tparam )* ','? )? '>' ;
Tparam = Attr* ( LIFE ( ':' LIFE? ( ADD LIFE )* )? | Name ( ':' Bounds? )? ( '=' Type )? | 'const' Name ':' Type ( '=' Targ )? ) ;
Where = 'where' ( WhereItem ( ',' WhereItem )* ','? )? ;
WhereItem = LIFE ':' Bounds | ForLife? Type ':' Bounds? ;
Bounds = Bound ( ADD Bound )* ADD? ;
Bound = LIFE | '?'? UN? 'const'? ForLife? Path | paren{Bound} ;
ForLife = 'for' '<' ( LIFE ( ',' LIFE )* )? '>' ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Attr* ( ( '&' LIFE? )? 'mut'? 'self' ( ':' Type )? | Pat ':' Type | Type | '...' ) ;
Fields = ( Field ( ',' Field )* ','? )? ;
Field = Attr* Vis? Name ':' Type ;
TupleFields = ( Attr* Vis? Type ( ',' Attr* Vis? Type )* ','? )? ;
Variants = ( Variant ( ',' Variant )* ','? )? ;
Variant = Attr* Vis? Name ( curly{Fields} | paren{TupleFields} )? ( '=' Expr )? ;
Type = ForLife? ( Path | '&' LIFE? 'mut'? Type | AND LIFE? 'mut'? Type | '*' ( 'const' | 'mut' ) Type | paren{Types} | brack{ArrayType} | '!' | '_' | ( 'dyn' | 'impl' ) Bounds | 'unsafe'? ( 'extern' STR? )? 'fn' paren{Params} ( '->' Type )? | '<' Type ( 'as' Path )? '>' ( '::' Name Targs? )+ | Name '!' paren{AnyTokens} ) ;
Types = ( Type ( ',' Type )* ','? )? ;
ArrayType = Type ( ';' Expr )? ;
Path = '::'? PathSeg ( '::' PathSeg )* ;
PathSeg = Seg ( '::'? Targs )? | Seg paren{Types} ( '->' Type )? ;
Targs = '<' ( Targ ( ',' Targ )* ','? )? '>' ;
Targ = LIFE | Type | Name Targs? ( '=' Type | ':' Bounds ) | ADD? NUM | STR | curly{Block} | 'true' | 'false' ;
Block = Stmt* Expr? ;
Stmt = ';' | 'let' Pat ( ':' Type )? ( '=' Expr ( 'else' curly{Block} )? )? ';' | Attr* 'let' Pat ( ':' Type )? ( '=' Expr )? ';' | Item | Attr* Expr ';' | Attr* BlockExpr | Macro ;
BlockExpr = ( LIFE ':' )? ( 'if' Cond curly{Block} Else? | 'match' NoStruct curly{Arms} | 'loop' curly{Block} | 'while' Cond curly{Block} | 'for' Pat 'in' NoStruct curly{Block} | ( 'unsafe' | 'const' | 'async' 'move'? )? curly{Block} ) ;
Cond = CondPart ( AND CondPart )* ;
CondPart = 'let' Pat '=' NoStruct | NoStruct ;
Else = 'else' ( curly{Block} | 'if' Cond curly{Block} Else? ) ;
Arms = ( Attr* Pat ( 'if' Cond )? '=>' ( Expr ',' | BlockExpr ','? ) )* ( Attr* Pat ( 'if' Cond )? '=>' Expr )? ;
Pat = '|'? Pat1 ( '|' Pat1 )* ;
Pat1 = '_' | '..' | PatRange | ( 'ref' | 'mut' )* Name ( '@' Pat1 )? | Path ( paren{Pats} | curly{FieldPats} )? | ( '&' | AND ) 'mut'? Pat1 | paren{Pats} | brack{Pats} | Macro | 'box' Pat1 ;
PatRange = PatLit ( ( '..' | '..=' ) PatLit? )? | ( '..=' | '..' ) PatLit | Path ( '..=' | '..' ) PatLit? ;
PatLit = ADD? NUM | STR | CHAR | 'true' | 'false' | Path ;
Pats = ( Pat ( ',' Pat )* ','? )? ;
FieldPats = ( FieldPat ( ',' FieldPat )* ','? )? ;
FieldPat = Attr* ( ( 'ref' | 'mut' )* Name | ( Name | NUM ) ':' Pat | '..' ) ;
Expr = Jump | Unary ( Bin Unary | 'as' Type | Range Unary? )* ( ( '=' | ASG ) Expr )? | Range Unary? ( Bin Unary )* | 'let' Pat '=' Expr ;
Range = '..' | '..=' ;
Jump = ( 'return' | 'yield' ) Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | Closure ;
Closure = ( 'static' | 'async' | 'move' )* ( OR | '|' ( ClosureParam ( ',' ClosureParam )* ','? )? '|' ) ( '->' Type )? Expr ;
ClosureParam = Pat1 ( ':' Type )? ;
Bin = BIN | AND | OR | ADD | '*' | '<' | '>' | '>' '>' | '&' | '|' ;
Unary = ( ADD | '!' | '*' | '&' 'mut'? | AND 'mut'? | '&' 'raw' ( 'const' | 'mut' ) )* ( Postfix | Jump ) ;
Postfix = Prim Tail* ;
Tail = '?' | '.' ( Name ( '::' Targs )? | NUM | 'await' ) | paren{Args} | brack{Expr} ;
Prim = Prim1 | Path curly{Inits} ;
Prim1 = Path | NUM | STR | CHAR | 'true' | 'false' | '_' | paren{Tuple} | brack{Array} | BlockExpr | Macro | '<' Type ( 'as' Path )? '>' ( '::' Name ( '::' Targs )? )+ ;
NoStruct = Jump | UnaryN ( Bin UnaryN | 'as' Type | Range UnaryN? )* ( ( '=' | ASG ) NoStruct )? | Range UnaryN? ;
UnaryN = ( ADD | '!' | '*' | '&' 'mut'? | AND 'mut'? )* Prim1 Tail* ;
Macro = Path '!' ( paren{AnyTokens} | brack{AnyTokens} | curly{AnyTokens} ) ;
Args = ( Attr* Expr ( ',' Attr* Expr )* ','? )? ;
Tuple = ( Expr ( ',' Expr )* ','? )? ;
Array = ( Expr ( ';' Expr | ( ',' Expr )* ','? ) )? ;
Inits = ( Init ( ',' Init )* ','? )? ;
Init = Attr* ( ( Name | NUM ) ( ':' Expr )? | '..' Expr? ) ;
Name = ID | 'union' | 'auto' | 'default' | 'raw' | 'box' | 'yield' ;
"""

PHP = """
File = Stmt* ;
Block = Stmt* ;
Stmt = curly{Block} | ';' | HTML | 'namespace' ( Path ';' | Path? curly{Block} ) | 'use' ( 'function' | 'const' )? UseItem ( ',' UseItem )* ';' | Attr* Func | Class | 'const' ConstItem ( ',' ConstItem )* ';' | Expr ';'
  | ( 'echo' | 'print' ) Args1 ';' | 'if' paren{Expr} ( Stmt Elif* ( 'else' Stmt )? | ':' Block ( 'elseif' paren{Expr} ':' Block )* ( 'else' ':' Block )? 'endif' ';' ) | 'while' paren{Expr} ( Stmt | ':' Block 'endwhile' ';' ) | 'do' Stmt 'while' paren{Expr} ';'
  | 'for' paren{ForHead} ( Stmt | ':' Block 'endfor' ';' ) | 'foreach' paren{EachHead} ( Stmt | ':' Block 'endforeach' ';' ) | 'switch' paren{Expr} ( curly{Cases} | ':' Cases 'endswitch' ';' ) | ( 'break' | 'continue' ) NUM? ';' | 'return' Expr? ';'
  | 'try' curly{Block} ( 'catch' paren{CatchHead} curly{Block} )* ( 'finally' curly{Block} )? | 'global' VAR ( ',' VAR )* ';' | 'static' VAR ( '=' Expr )? ( ',' VAR ( '=' Expr )? )* ';' | 'unset' paren{Args} ';' | 'declare' paren{AnyTokens} ( ';' | curly{Block} ) | 'goto' Name ';' | Name ':' ;
Elif = 'elseif' paren{Expr} Stmt | 'else' 'if' paren{Expr} Stmt ;
UseItem = Path ( 'as' Name )? | Path BSL curly{UseItems} ;
UseItems = ( UseItem ( ',' UseItem )* ','? )? ;
Path = BSL? Name ( BSL Name )* ;
ConstItem = Name '=' Expr ;
Attr = '#' brack{AnyTokens} ;
Func = 'function' '&'? Word paren{Params} ( ':' Type )? curly{Block} ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Attr* MOD* Type? '&'? '...'? VAR ( '=' Expr )? ;
Type = '?'? Type1 ( ( '|' | '&' ) Type1 )* ;
Type1 = Path | 'array' | 'static' | 'callable' | 'null' | 'true' | 'false' | 'self' | 'parent' | paren{Type} ;
Class = Attr* ( MOD | 'static' )* ( 'class' Name ( 'extends' Path )? ( 'implements' Paths )? curly{Body} | 'interface' Name ( 'extends' Paths )? curly{Body} | 'trait' Name curly{Body} | 'enum' Name ( ':' Type )? ( 'implements' Paths )? curly{Body} ) ;
Paths = Path ( ',' Path )* ;
Body = Member* ;
Member = 'use' Paths ( ';' | curly{AnyTokens} ) | Attr* ( MOD | 'static' | 'var' )* ( 'const' Type? ConstItem1 ( ',' ConstItem1 )* ';' | 'function' '&'? Word paren{Params} ( ':' Type )? ( curly{Block} | ';' ) | Type? VAR ( '=' Expr )? ( ',' VAR ( '=' Expr )? )* ';' ) | 'case' Word ( '=' Expr )? ';' ;
ConstItem1 = Word '=' Expr ;
ForHead = Args ';' Args ';' Args ;
EachHead = Expr 'as' ( Target '=>' )? '&'? Target ;
Target = Postfix | brack{Items} | 'list' paren{Items} ;
Cases = ( ( 'case' Expr | 'default' ) ( ':' | ';' ) Block )* ;
CatchHead = Type VAR? ;
Args1 = Expr ( ',' Expr )* ;
Args = ( Arg ( ',' Arg )* ','? )? ;
Arg = ( Word ':' )? '...'? Expr | '...' ;
Expr = Unary ( Bin Unary | 'instanceof' Unary )* ( '?' Expr? ':' Expr )* ( ( '=' '&'? | ASG ) Expr )? ( LOGIC Expr )? ;
Bin = BIN | ADD | '*' | '<' | '>' | '&' | '|' | '.' | '??' ;
Unary = ( ADD | UN | '!' | INC | '&' | SILENT | 'new' | 'clone' | 'print' | 'yield' 'from'? | 'throw' | 'include' | 'require' | CAST )* Postfix | 'yield' ( Expr ( '=>' Expr )? )? | Fn ;
Fn = Attr* 'static'? ( 'function' '&'? paren{Params} ( 'use' paren{Params} )? ( ':' Type )? curly{Block} | 'fn' '&'? paren{Params} ( ':' Type )? '=>' Expr ) ;
Postfix = Prim Tail* INC? ;
Prim = VAR | '$' Prim | '$' curly{Expr} | Path | NUM | STR | 'null' | 'true' | 'false' | 'self' | 'parent' | 'static' | 'array' paren{Items} | brack{Items} | 'list' paren{Items} | paren{Expr} | Fn | 'match' paren{Expr} curly{Arms} | 'class' paren{Args}? ( 'extends' Path )? ( 'implements' Paths )? curly{Body} | ( 'isset' | 'empty' | 'exit' ) paren{Args}? ;
Arms = ( Arm ( ',' Arm )* ','? )? ;
Arm = ( Args1 ','? | 'default' ) '=>' Expr ;
Items = ','* ( Item ( ','+ Item )* )? ','* ;
Item = ( Expr '=>' )? '&'? Expr | '...' Expr ;
Tail = ( '->' | '?->' ) ( Word | VAR | curly{Expr} ) | '::' ( Word | VAR | 'class' | curly{Expr} ) | brack{Sub} | curly{Expr} | paren{Args} ;
Sub = Expr? ;
Name = ID | 'enum' | 'match' | 'from' | 'fn' ;
Word = Name | 'array' | 'callable' | 'list' | 'class' | 'const' | 'default' | 'static' | 'print' | 'echo' | 'function' | 'new' | 'clone' | 'use' | 'var' | 'for' | 'foreach' | 'while' | 'do' | 'if' | 'else' | 'elseif' | 'switch' | 'case' | 'break' | 'continue' | 'return' | 'try' | 'catch' | 'finally' | 'throw' | 'global' | 'unset' | 'isset' | 'empty' | 'exit' | 'include' | 'require' | 'self' | 'parent' | 'null' | 'true' | 'false' | 'namespace' | 'interface' | 'trait' | 'extends' | 'implements' | 'instanceof' | 'as' | 'yield' | 'goto' | 'declare' | MOD ;
"""

RUBY = """
File = Body ;
Body = ( Stmt? ';' )* Stmt? ;
Stmt = Stmt1 ( 'if' Expr | 'unless' Expr | 'while' Expr | 'until' Expr | 'rescue' Expr )* ;
Stmt1 = Lhs ( '=' | ASG ) Rhs | Expr ( ( 'and' | 'or' ) ( Expr | Lhs ( '=' | ASG ) Rhs ) )* | 'not' Expr | 'alias' Sym Sym | 'undef' Sym | 'BEGIN' curly{Body} | 'END' curly{Body} ;
Sym = Word | SYM | VAR ;
Then = ';' | 'then' | ';' 'then' ;
Keyword = 'def' DefHead ( ';' | ParenEnd ) ';'? Rescue | 'def' DefHead Rescue | 'class' ( Path ( '<' Expr )? | '<<' Expr ) ';' Rescue | 'module' Path ';' Body | 'begin' Rescue
  | ( 'if' | 'unless' ) Stmt Then Body ( 'elsif' Stmt Then Body )* ( 'else' Body )? | ( 'while' | 'until' ) Stmt ( ';' | 'do' ) Body | 'for' Lhs 'in' Expr ( ';' | 'do' ) Body
  | 'case' Expr? ';' ( 'when' Args Then Body )+ ( 'else' Body )? | 'case' Expr ';' ( 'in' Pattern ( ( 'if' | 'unless' ) Expr )? Then Body )+ ( 'else' Body )? ;
ParenEnd = NEVER ;
Rescue = Body ( 'rescue' ( Args? ( '=>' Lhs1 )? ) Then Body )* ( 'else' Body )? ( 'ensure' Body )? ;
DefHead = ( ( 'self' | Path | VAR ) '.' )? MethName ( paren{Params} | Params1 )? ;
MethName = Word | OpName | brack{Nothing} '='? ;
OpName = BIN | ADD | '*' | '<' | '>' | '!' | UN | '<<' | '|' | '&' | '[]' ;
Nothing = ;
Params = ( ';'* Param ( ',' ';'* Param )* ','? ';'* ( ';' ID ( ',' ID )* )? )? ;
Params1 = Param ( ',' Param )* ;
Param = ID ( '=' Expr )? | LABEL Expr? | ( '*' | '**' | '&' ) ID? | ( '*' | '**' | '&' ) 'nil' | paren{Params} | '...' ;
BlockParams = '|' ( Param ( ',' Param )* ','? )? ( ';' ID ( ',' ID )* )? '|' | OR ;
DoBlock = 'do' BlockParams? Rescue ;
BraceBlock = ';'* BlockParams? Body ;
Pattern = AnyPat ;
AnyPat = ( Expr | LABEL Expr? | '^' ID | ( '*' | '**' ) ( ID | 'nil' )? | '|' | ',' | '=>' )+ ;
Lhs1 = Postfix | VAR ;
Lhs = ( '*'? Lhs1 | paren{Lhs} ) ( ',' ( '*'? Lhs1 | paren{Lhs} ) )* ','? ;
Expr = Unary ( Bin Unary )* ( '?' Expr ( ':' Expr | LABELISH Expr ) )? ( ( '=' | ASG ) ';'? Rhs1 )? | 'not' Expr | Command | 'defined' Expr | ( 'return' | 'break' | 'next' ) Rhs? | 'redo' | 'retry' | 'yield' ( paren{Args} | CmdArgs )? ;
Rhs1 = Expr ( 'rescue' Expr )? ;
Rhs = ';'? '*'? Expr ( ',' '*'? Expr )* ( 'rescue' Expr )? ;
Bin = BIN | ADD | '*' | '**' | '<' | '>' | '<<' | '&' | '|' | OR | '..' | '..' | '^' ;
Unary = ( ADD | UN | '!' | '&' | 'defined' | '*' | '**' )* Postfix | Postfix '..' ;
Command = Postfix1 CmdArgs block{DoBlock}? ;
CmdArgs = CmdArg ( ',' ';'? CmdArg )* ;
CmdArg = ( '*' | '**' | '&' )? Expr ( '=>' Expr )? | LABEL Expr? | STR ':' Expr ;
Postfix1 = ( Prim Tail* ( '.' | '&.' | '::' ) )? ( Word | CONST ) | 'super' | 'yield' | 'puts' ;
Postfix = Prim Tail* ;
Tail = ( '.' | '&.' | '::' ) ( Word | CONST | OpName | paren{Args} ) | paren{Args} | brack{Args} | curly{BraceBlock} | block{DoBlock} ;
Prim = ID | CONST | VAR | NUM | STR STR* | SYM | REGEX | HEREDOC | 'nil' | 'true' | 'false' | 'self' | 'super' | '__method__' | paren{Body} | brack{Args} | curly{Hash} | block{Keyword} | 'DEF' DefHead '=' ';'? Stmt | ARROW ( paren{Params} | Params1 )? ( curly{BraceBlock} | block{DoBlock} ) | '::' CONST | 'yield' ;
Path = '::'? CONST ( '::' CONST )* ;
Args = ';'* ( Arg ( ',' ';'* Arg )* ','? )? ';'* ;
Arg = ( '*' | '**' | '&' )? Expr ( '=>' ';'? Expr )? | LABEL ( ';'? Expr )? | STR ':' Expr | '&' | '*' | '**' | Command ;
Hash = ';'* ( Pair ( ',' ';'* Pair )* ','? )? ';'* ;
Pair = Expr '=>' ';'? Expr | LABEL ( ';'? Expr )? | STR ':' ';'? Expr | '**' Expr ;
Word = ID | CONST | 'class' | 'def' | 'end' | 'if' | 'unless' | 'while' | 'until' | 'then' | 'begin' | 'case' | 'when' | 'in' | 'do' | 'for' | 'nil' | 'true' | 'false' | 'self' | 'super' | 'module' | 'and' | 'or' | 'not' | 'return' | 'next' | 'break' | 'redo' | 'retry' | 'rescue' | 'ensure' | 'else' | 'elsif' | 'yield' | 'alias' | 'undef' | 'defined' | 'BEGIN' | 'END' ;
"""

_PYTHON3 = """
File = Stmt* ;
Stmt = Simple ( SEMI Simple )* SEMI? ';' | Compound | ';' ;
Suite = ( Simple ( SEMI Simple )* SEMI? ';' ) | ';' block{File} ;
Simple = ExprStmt | 'return' Plain? | 'import' Dotted ( ',' Dotted )* | 'from' ( ( '.' | '...' )+ DottedName? | DottedName ) 'import' ( '*' | Aliases | paren{Aliases} ) | 'pass' | 'break' | 'continue' | 'raise' ( Expr ( 'from' Expr )? )? | 'del' Exprs | ( 'global' | 'nonlocal' ) Name ( ',' Name )* | 'assert' Expr ( ',' Expr )? | 'type' Name Tp? '=' Expr ;
Dotted = DottedName ( 'as' Name )? ;
DottedName = Name ( '.' Name )* ;
Aliases = Alias ( ',' Alias )* ','? ;
Alias = Name ( 'as' Name )? ;
ExprStmt = Plain | Yield | ( Targets '=' )+ ( Plain | Yield ) | Target1 ':' Expr ( '=' ( Plain | Yield ) )? | Target1 ASG ( Plain | Yield ) ;
Plain = PlainStar ( ',' PlainStar )* ','? ;
PlainStar = '*'? Expr ;
Yield = 'yield' ( 'from' Expr | Exprs )? ;
Compound = ( '@' Named DNL )* ( 'async'? 'def' Name Tp? paren{Params} ( '->' Expr )? ':' Suite | 'class' Name Tp? paren{Args}? ':' Suite )
  | 'if' Named ':' Suite ( 'elif' Named ':' Suite )* ( 'else' ':' Suite )? | 'while' Named ':' Suite ( 'else' ':' Suite )? | 'async'? 'for' Targets 'in' Exprs ':' Suite ( 'else' ':' Suite )?
  | 'try' ':' Suite ( ( 'except' '*'? ( Exprs ( 'as' Name )? )? ':' Suite )+ ( 'else' ':' Suite )? ( 'finally' ':' Suite )? | 'finally' ':' Suite ) | 'async'? 'with' ( WithItem ( ',' WithItem )* | paren{WithItems} ) ':' Suite
  | 'match' Exprs ':' ';' block{Cases} ;
WithItem = Expr ( 'as' Target )? ;
WithItems = WithItem ( ',' WithItem )* ','? ;
Cases = ( 'case' Patterns ( 'if' Named )? ':' Suite )+ ;
Patterns = Pattern ( ',' Pattern )* ','? ;
Pattern = '*'? Pattern1 ( '|' Pattern1 )* ( 'as' Name )? ;
Pattern1 = ADD? NUM ( ADD NUM )? | STR+ | 'None' | 'True' | 'False' | DottedName paren{PatArgs}? | paren{PatList} | brack{PatList} | curly{PatMap} ;
PatArgs = ( PatArg ( ',' PatArg )* ','? )? ;
PatArg = ( Name '=' )? Pattern ;
PatList = ( Pattern ( ',' Pattern )* ','? )? ;
PatMap = ( PatPair ( ',' PatPair )* ','? )? ;
PatPair = Pattern1 ':' Pattern | '**' Name ;
Tp = brack{TparamList} ;
TparamList = Tparam ( ',' Tparam )* ','? ;
Tparam = ( '*' | '**' )? Name ( ':' Expr )? ( '=' Expr )? ;
Params = ( Param ( ',' Param )* ','? )? ;
Param = Name ( ':' Expr )? ( '=' Expr )? | '*' ( Name ( ':' '*'? Expr )? )? | '**' Name ( ':' Expr )? | '/' ;
LParams = LParam ( ',' LParam )* ','? ;
LParam = Name ( '=' Expr )? | '*' Name? | '**' Name | '/' ;
Targets = Target ( ',' Target )* ','? ;
Target = '*'? Target1 ;
Target1 = Name | Prim ( '.' Name | paren{Args} | brack{Subs} )* ( '.' Name | brack{Subs} ) | paren{TargetGroup} | brack{TargetGroup} ;
TargetGroup = Targets? ;
Exprs = Star ( ',' Star )* ','? ;
Star = '*' Expr | Named ;
Named = ( Name WALRUS )? Expr ;
Expr = 'lambda' LParams? ':' Expr | Test ( 'if' Test 'else' Expr )? ;
Test = Unary ( Bin Unary )* ;
Bin = BIN | ADD | '*' | '**' | '/' | '@' | '|' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Unary = ( 'not' | ADD | UN )* 'await'? Postfix ;
Postfix = Prim ( '.' Name | paren{Args} | brack{Subs} )* ;
Prim = Name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | paren{Group} | brack{List} | curly{DictSet} ;
Group = ( Yield | Exprs | Named For+ )? ;
List = ( Exprs | Named For+ )? ;
DictSet = ( DictItem ( ',' DictItem )* ','? | Exprs | Expr ':' Expr For+ | Named For+ )? ;
DictItem = Expr ':' Expr | '**' Expr ;
For = 'async'? 'for' Targets 'in' Test ( 'if' CondTest )* ;
CondTest = ( Name WALRUS )? ( Test | 'lambda' LParams? ':' Expr ) ;
Args = ( Arg ( ',' Arg )* ','? )? ;
Arg = Name '=' Expr | '*' Expr | '**' Expr | Named For* ;
Subs = Sub ( ',' Sub )* ','? ;
Sub = '*'? Named | Expr? ':' Expr? ( ':' Expr? )? ;
Name = ID | 'match' | 'case' | 'type' | 'print' | 'exec' ;
"""
#: Python 2: print, exec and raise statements, old except clauses, numbers and operators; no annotations, async or match.
PYTHON = _PYTHON3 + dialect(
    _PYTHON3,
    "2",
    Simple="Plain | Yield | ( Targets '=' )+ ( Plain | Yield ) | Target1 ASG ( Plain | Yield ) | 'print' ( BIN Test ( ',' Exprs )? | Exprs )? | 'exec' Exprs | 'return' Plain? | 'import' Dotted ( ',' Dotted )* | 'from' ( ( '.' | '...' )+ DottedName? | DottedName ) 'import' ( '*' | Aliases | paren{Aliases} )"
    " | 'pass' | 'break' | 'continue' | 'raise' ( Expr ( ',' Expr ( ',' Expr )? )? )? | 'del' Exprs | 'global' Name ( ',' Name )* | 'assert' Expr ( ',' Expr )?",
    PlainStar="Expr",
    Yield="'yield' Exprs?",
    Compound="( '@' Named DNL )* ( 'def' Name paren{Params} ':' Suite | 'class' Name paren{Args}? ':' Suite ) | 'if' Named ':' Suite ( 'elif' Named ':' Suite )* ( 'else' ':' Suite )? | 'while' Named ':' Suite ( 'else' ':' Suite )? | 'for' Targets 'in' Exprs ':' Suite ( 'else' ':' Suite )?"
    " | 'try' ':' Suite ( ( 'except' ( Expr ( ( 'as' | ',' ) Target )? )? ':' Suite )+ ( 'else' ':' Suite )? ( 'finally' ':' Suite )? | 'finally' ':' Suite ) | 'with' WithItem ( ',' WithItem )* ':' Suite",
    Param="( Name | paren{TargetGroup} ) ( '=' Expr )? | '*' Name | '**' Name",
    LParam="( Name | paren{TargetGroup} ) ( '=' Expr )? | '*' Name | '**' Name",
    Target="Target1",
    Star="Named",
    Named="Expr",
    Bin="BIN | LTGT | ADD | '*' | '**' | '/' | '|' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not'",
    Unary="( 'not' | ADD | UN )* Postfix",
    Prim="Name | NUM | OLDNUM | ( STR | OLDSTR )+ | 'None' | 'True' | 'False' | '...' | paren{Group} | brack{List} | curly{DictSet} | TICK Exprs TICK",
    DictItem="Expr ':' Expr",
    For="'for' Targets 'in' Test ( ',' Test )* ','? ( 'if' CondTest )*",
    CondTest="Test | 'lambda' LParams? ':' Expr",
    Sub="Named | Expr? ':' Expr? ( ':' Expr? )?",
    Name="ID | 'match' | 'case' | 'type' | 'print' | 'async' | 'await' | 'nonlocal'",
)

CPP = """
File = Item* ;
Item = ';' | 'inline'? 'namespace' Attr* ( Name ( '::' 'inline'? Name )* )? ( curly{File} | '=' QName ';' ) | 'extern' STR ( curly{File} | Item ) | Template* Decl | Template* Func | 'using' ( 'namespace' QName | 'enum'? 'typename'? QName ( ',' QName )* | Name Attr* '=' Type ) ';' | Template 'using' Name '=' Type ';' | 'static_assert' paren{AnyTokens} ';' | Template* 'concept' Name '=' Expr ';' | Name paren{AnyTokens} ;
Template = 'template' ( '<' Tparams? '>' ( 'requires' Cond )? )? ;
Tparams = Tparam ( ',' Tparam )* ;
Tparam = Template? ( 'typename' | 'class' ) '...'? Name? ( '=' Type )? | Spec+ Declr? ( '=' Cond1 )? | QName Targs? '...'? Name ( '=' Type )? ;
Attr = brack{AnyTokens} | 'alignas' paren{AnyTokens} | '__attribute__' paren{AnyTokens} ;
Spec = MOD | 'inline' | 'static' | 'extern' | 'const' | 'constexpr' | PRIM | 'auto' | 'decltype' paren{AnyTokens} | 'typename' QName | Attr | 'explicit' paren{Expr}? | 'virtual' | 'friend' | 'typedef' | 'mutable' ;
Specs = Spec* ( QName | ClassHead | EnumHead )? Spec* ;
Type = Specs1 AbsDeclr? ;
Specs1 = Spec+ | Spec* ( QName | ( 'class' | 'struct' | 'union' | 'enum' ) QName ) Spec* ;
ClassHead = ( 'class' | 'struct' | 'union' ) Attr* QName? 'final'? ( ':' Base ( ',' Base )* )? curly{Body} | ( 'class' | 'struct' | 'union' ) QName ;
Base = ( ACCESS | 'virtual' )* QName '...'? ;
EnumHead = 'enum' ( 'class' | 'struct' )? Attr* Name? ( ':' Type )? curly{EnumBody} | 'enum' ( 'class' | 'struct' )? QName ( ':' Type )? ;
EnumBody = ( EnumItem ( ',' EnumItem )* ','? )? ;
EnumItem = Name Attr* ( '=' Cond )? ;
Body = ( ACCESS ':' | Item | Ctor )* ;
Decl = Specs1 ( InitDeclr ( ',' InitDeclr )* )? ';' | Spec* ( ClassHead | EnumHead ) Spec* ( InitDeclr ( ',' InitDeclr )* )? ';' ;
InitDeclr = Declr ( ':' Cond )? ( '=' Init | curly{Inits} | paren{Args} )? ;
Init = Expr1 | curly{Inits} | 'default' | 'delete' ;
Inits = ( InitItem ( ',' InitItem )* ','? )? ;
InitItem = ( '.' Name | brack{Expr} )* '='? ( Expr1 | curly{Inits} ) '...'? ;
Declr = Ptr* ( '...'? DeclName | paren{Declr} ) ( brack{Index} | paren{Params} FnTail* )* ;
AbsDeclr = Ptr+ ( paren{AbsDeclr}? ( brack{Index} | paren{Params} FnTail* )* ) '...'? | '...' | paren{AbsDeclr} ( brack{Index} | paren{Params} FnTail* )+ | ( brack{Index} | paren{Params} FnTail* )+ ;
Ptr = ( '*' | '&' | AND | QName '::' '*' ) ( 'const' | MOD )* ;
DeclName = QName | UN Name | QName '::' UN Name | OpName | QName '::' OpName | brack{Names} ;
Names = Name ( ',' Name )* ;
OpName = 'operator' ( BIN | ADD | '*' | '<' | '>' | '>' '>' | '&' | AND | '|' | OR | UN | '!' | INC | '=' | ASG | ',' | '->' | paren{Nothing} | brack{Nothing} | ( 'new' | 'delete' ) brack{Nothing}? | Type | STR Name ) ;
Nothing = ;
Index = Expr? ;
Params = ( Param ( ',' Param )* ','? '...'? | '...' )? ;
Param = Attr* Specs1 ( Declr | AbsDeclr )? ( '=' Init )? ;
FnTail = 'const' | 'mutable' | 'constexpr' | 'static' | MOD | '&' | AND | 'noexcept' paren{AnyTokens}? | 'override' | 'final' | '->' Type | 'throw' paren{AnyTokens} | 'requires' Cond | Attr ;
Func = Spec* ( QName Spec* )? Declr FnTail* ( ':' MemInit ( ',' MemInit )* )? ( curly{Stmts} | 'try' curly{Stmts} Catch+ | '=' ( 'default' | 'delete' | NUM ) ';' ) ;
Ctor = Template* Spec* UN? Name paren{Params} FnTail* ( ':' MemInit ( ',' MemInit )* )? ( curly{Stmts} | ';' | '=' ( 'default' | 'delete' ) ';' ) ;
MemInit = QName ( paren{Args} | curly{Inits} ) '...'? ;
Stmts = Stmt* ;
Stmt = curly{Stmts} | Expr? ';' | Template* Decl | 'using' ( 'namespace' QName | 'typename'? QName | Name '=' Type ) ';' | 'static_assert' paren{AnyTokens} ';' | 'if' ( 'constexpr' | '!'? 'consteval' )? paren{Head}? Stmt ( 'else' Stmt )? | 'for' paren{ForHead} Stmt | 'while' paren{Head} Stmt | 'do' Stmt 'while' paren{Expr} ';'
  | ( 'return' | 'co_return' ) ( Expr | curly{Inits} )? ';' | 'break' ';' | 'continue' ';' | 'goto' Name ';' | 'try' curly{Stmts} Catch+ | 'switch' paren{Head} Stmt | ( 'case' Cond | 'default' ) ':' Stmt? | Name ':' Stmt? | Attr+ Stmt | 'asm' MOD? paren{AnyTokens} ';' ;
Catch = 'catch' paren{CatchHead} curly{Stmts} ;
CatchHead = Param | '...' ;
Head = ( Specs1 InitDeclr ( ',' InitDeclr )* ';' | Expr? ';' )? ( Expr | Specs1 InitDeclr ) ;
ForHead = ( Specs1 InitDeclr ( ',' InitDeclr )* | Expr )? ';' Expr? ';' Expr? | ( Expr? ';' )? Attr* Specs1 Declr ':' ( Expr | curly{Inits} ) ;
Args = ( Arg ( ',' Arg )* )? ;
Arg = ( Expr1 | curly{Inits} | Type ) '...'? ;
Expr = Expr1 ( ',' Expr1 )* ;
Expr1 = Cond ( ( '=' | ASG ) ( Expr1 | curly{Inits} ) )? | 'throw' Expr1? | 'co_yield' Expr1 ;
Cond = Unary ( Bin Unary )* ( '?' Expr? ':' Expr1 )? ;
Cond1 = UnaryN ( Bin1 UnaryN )* ;
Bin1 = BIN | ADD | '*' | '&' | '|' | AND | OR ;
UnaryN = Unary ;
Bin = BIN | ADD | '*' | '<' | '>' | '>' '>' | '&' | '|' | AND | OR | '.*' | '->*' ;
Unary = ( ADD | UN | '!' | INC | '*' | '&' | AND | 'sizeof' '...'? | 'alignof' | 'co_await' | paren{Type} )* Postfix ;
Postfix = Prim Tail* ;
Prim = QName | NUM | STR+ | CHAR | 'true' | 'false' | 'nullptr' | 'this' | paren{Expr} | paren{Fold} | ( PRIM | QName | 'auto' ) curly{Inits} | PRIM+ paren{Args} | 'typename' QName ( paren{Args} | curly{Inits} ) | CASTOP '<' Type '>' paren{Expr} | ( 'sizeof' | 'alignof' | 'typeid' | 'noexcept' ) paren{AnyTokens} | '::'? 'new' paren{Args}? ( Specs1 Ptr* brack{Expr}* | paren{Type} ) ( paren{Args} | curly{Inits} )? | '::'? 'delete' brack{Nothing}? Unary | Lambda | 'requires' paren{Params}? curly{AnyTokens} | 'operator' AnyOp paren{Args} | 'decltype' paren{AnyTokens} ;
AnyOp = BIN | ADD | '*' | '=' ;
Fold = AnyFold ;
AnyFold = ( Cond Bin )? '...' ( Bin Cond )? | Cond Bin '...' ;
Lambda = brack{Captures} Lparams? FnTail* curly{Stmts} ;
Lparams = ( '<' Tparams '>' )? paren{Params} ;
Captures = ( Capture ( ',' Capture )* )? ;
Capture = '&' | '=' | '&'? '...'? Name '...'? ( '=' Expr1 | curly{Inits} | paren{Args} )? | '*'? 'this' ;
Tail = ( '.' | '->' ) 'template'? ( UN? QName | OpName ) | brack{Args} | paren{Args} | INC ;
QName = '::'? ( 'template'? Name Targs? '::' )* 'template'? Name Targs? ;
Targs = '<' ( Targ ( ',' Targ )* )? '>' ;
Targ = ( Type | Cond1 ) '...'? ;
Name = ID | 'final' | 'override' ;
"""

#: What a header may hold: C++, where the words of C only are names, and C, where those of C++ only are.
HEADER = CPP.replace("Name = ID |", "Name = ID | CQUAL | COF | '_Atomic' | GENERIC |") + """
CFile = CItem* ;
CItem = ';' | 'extern' STR ( curly{CFile} | CItem ) | CDecl | CFunc | 'static_assert' paren{AnyTokens} ';' | CName paren{AnyTokens} ;
CSpec = MOD | CQUAL | COF paren{AnyTokens} | '_Atomic' paren{AnyTokens}? | 'inline' | 'static' | 'extern' | 'const' | 'constexpr' | PRIM | 'auto' | 'typedef' | CAttr ;
CAttr = brack{AnyTokens} | 'alignas' paren{AnyTokens} | '__attribute__' paren{AnyTokens} ;
CSpecs = CSpec+ | CSpec* ( CName | CTag ) CSpec* ;
CTag = ( 'struct' | 'union' ) CAttr* ( CName? curly{CBody} | CName ) | 'enum' CAttr* ( CName? ( ':' CType )? curly{CEnums} | CName ) ;
CBody = ( ';' | CSpecs ( CField ( ',' CField )* )? ';' | 'static_assert' paren{AnyTokens} ';' | CName paren{AnyTokens} )* ;
CField = CDeclr ( ':' CCond )? CAttr* | ':' CCond ;
CEnums = ( CEnum ( ',' CEnum )* ','? )? ;
CEnum = CName CAttr* ( '=' CCond )? ;
CDecl = CSpecs ( CInit ( ',' CInit )* )? ';' ;
CInit = CDeclr CLabel* ( '=' ( CExpr1 | curly{CInits} ) )? ;
CLabel = CAttr | 'asm' paren{AnyTokens} ;
CInits = ( CInitItem ( ',' CInitItem )* ','? )? ;
CInitItem = ( ( '.' CName | brack{CRange} )+ '=' )? ( CExpr1 | curly{CInits} ) ;
CRange = CCond ( '...' CCond )? ;
CDeclr = CPtr* ( CName | paren{CInner} ) ( brack{CIndex} | paren{CParams} )* ;
CInner = CAttr* CDeclr ;
CPtr = '*' ( 'const' | MOD | CQUAL | '_Atomic' | CAttr )* ;
CIndex = ( 'static' | 'const' | MOD | '_Atomic' )* ( CExpr1 | '*' )? ;
CParams = ( CParam ( ',' CParam )* ( ',' '...' )? | '...' )? ;
CParam = CSpecs ( CDeclr | CAbs )? CAttr* ;
CAbs = CPtr+ paren{CAbsIn}? ( brack{CIndex} | paren{CParams} )* | paren{CAbsIn} ( brack{CIndex} | paren{CParams} )+ | ( brack{CIndex} | paren{CParams} )+ ;
CAbsIn = CAbs ;
CType = CSpecs CAbs? ;
CFunc = CSpecs? CPtr* ( CName paren{CParams} | paren{CInner} ( brack{CIndex} | paren{CParams} )+ ) CAttr* CDecl* curly{CStmts} ;
CStmts = CStmt* ;
CStmt = curly{CStmts} | CExpr? ';' | CDecl | 'static_assert' paren{AnyTokens} ';' | 'if' paren{CExpr} CStmt ( 'else' CStmt )? | 'for' paren{CFor} CStmt | 'while' paren{CExpr} CStmt | 'do' CStmt 'while' paren{CExpr} ';'
  | 'return' CExpr? ';' | 'break' ';' | 'continue' ';' | 'goto' CName ';' | 'switch' paren{CExpr} CStmt | ( 'case' CRange | 'default' ) ':' CStmt? | CName ':' CStmt? | CAttr+ CStmt | 'asm' ( MOD | 'goto' )* paren{AnyTokens} ';' ;
CFor = ( CSpecs ( CInit ( ',' CInit )* )? | CExpr )? ';' CExpr? ';' CExpr? ;
CExpr = CExpr1 ( ',' CExpr1 )* ;
CExpr1 = CCond ( ( '=' | ASG ) CExpr1 )? ;
CCond = CUnary ( CBin CUnary )* ( '?' CExpr? ':' CExpr1 )? ;
CBin = BIN | ADD | '*' | '<' | '>' | '>' '>' | '&' | '|' | AND | OR ;
CUnary = ( ADD | UN | '!' | INC | '*' | '&' | AND | 'sizeof' | 'alignof' | paren{CType} )* CPrim COp* ;
CPrim = CName | NUM | STR+ | CHAR | paren{CExpr} | paren{CType} curly{CInits} | ( 'sizeof' | 'alignof' ) paren{CType} | GENERIC paren{CGeneric} ;
COp = ( '.' | '->' ) CName | brack{CExpr} | paren{CArgs} | INC ;
CArgs = ( CArg ( ',' CArg )* )? ;
CArg = CExpr1 | CType ;
CGeneric = CExpr1 ( ',' ( CType | 'default' ) ':' CExpr1 )+ ;
CName = ID | 'final' | 'override' | 'namespace' | 'using' | 'typename' | 'concept' | 'template' | 'requires' | 'decltype' | 'explicit' | 'virtual' | 'friend' | 'mutable' | 'class' | 'operator' | 'new' | 'delete' | 'noexcept' | 'throw' | 'try' | 'catch' | 'co_return' | 'co_await' | 'co_yield' | 'consteval' | 'constexpr' | 'typeid' | 'this' | 'true' | 'false' | 'nullptr' | 'alignas' | 'alignof' | 'static_assert' | 'asm' | ACCESS | CASTOP ;
"""
#: Where only tokens, brackets and how a text begins are described: what else stands there is accepted.
_LOOSE = """
Rest = ID | HEAD | NUM | STR | CHAR | LIFE | OP | START | paren{AnyTokens} | brack{AnyTokens} | curly{AnyTokens} ;
"""
KOTLIN = "File = ( ( HEAD | START ) Rest* )? ;" + _LOOSE
SWIFT = "File = ( ( ID | START | STR | NUM | curly{AnyTokens} | paren{AnyTokens} | brack{AnyTokens} ) Rest* )? ;" + _LOOSE
SQL = "File = ( ( HEAD | START | paren{AnyTokens} ) Rest* )? ;" + _LOOSE
CSS = "File = Rule* ; Rule = START ( ID | OP | NUM | STR | paren{AnyTokens} )* ( START | curly{AnyTokens} ) | ( ID | OP | START | NUM | STR | paren{AnyTokens} | brack{AnyTokens} )+ curly{AnyTokens} ;"
