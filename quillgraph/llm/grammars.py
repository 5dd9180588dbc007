"""Parsing-expression grammars of the languages whose files are checked."""

from __future__ import annotations

import re
from functools import lru_cache

from .peg import Grammar

_C_TRIVIA = r"\s+|//[^\n\r  ]*+|/\*(?:[^*]|\*(?!/))*+\*/"

_JS_OPERATORS = (
    "{ } ( ) [ ] . ... ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= "
    "&= |= ^= &&= ||= ??= => @ #"
)

_JS_RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with"
)
_JS_STRICT = "implements interface let package private protected public static yield await"


def _ecmascript(types: bool, markup: bool) -> str:
    ts = lambda yes, no="": yes if types else no
    reserved = _JS_RESERVED + ts("", " " + _JS_STRICT)
    word = r"(?:[A-Za-z_$ª-￿\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+"
    return rf"""
Program <- Hashbang? ModuleItem*
Hashbang <- /#![^\n]*/
ModuleItem <- Import | Export | Statement

Name <- /{word}/
Id <- /(?!(?:{reserved.replace(' ', '|')})(?![\w$])){word}/
String <- /"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"/ | /'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'/
Number <- /(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*+n?|0[bB][01](?:_?[01])*+n?|0[oO][0-7](?:_?[0-7])*+n?|(?:(?:0|[1-9](?:_?[0-9])*+)(?:n|\.(?:[0-9](?:_?[0-9])*+)?+)?|\.[0-9](?:_?[0-9])*+)(?:[eE][+\-]?[0-9](?:_?[0-9])*+)?)(?![\w$])/
Regex <- /\/(?![*\/])(?:[^\/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++\/[a-z]*(?![\w$])/
Template <- Whole | "`" TemplatePart* "`"
Whole <- /`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*+`/
TemplatePart <- TemplateText | TemplateHole
TemplateHole <- /\$\{{/ Expr HoleEnd
HoleEnd <- &"}}" CloseHole
CloseHole <- "}}"
TemplateText <- /(?:[^`\\$]|\\[\s\S]|\$(?!\{{))++/
Eos <- ';' | &'}}' | ^nl | !/[\s\S]/

Import <- 'import' {ts("'type'? ")}String Attributes? Eos
 | 'import' {ts("('type' !('from' String) )? ")}ImportClause 'from' String Attributes? Eos
 {ts("| 'export'? 'import' 'type'? Id '=' ('require' '(' String ')' | EntityName) Eos")}
Attributes <- ('with' | 'assert') '{{' ((Name | String) ':' String (',' (Name | String) ':' String)* ','?)? '}}'
ImportClause <- '*' 'as' Id | NamedImports | Id (',' ('*' 'as' Id | NamedImports))?
NamedImports <- '{{' (ImportSpec (',' ImportSpec)* ','?)? '}}'
ImportSpec <- {ts("'type' ImportSpecPlain !Name | ")}ImportSpecPlain
ImportSpecPlain <- (Name | String) 'as' Id | Id
Export <- Decorator* 'export' 'default' (Function | Class {ts("| 'abstract' Class | Interface ")}| Assign Eos)
 | 'export' {ts("'type'? ")}'*' ('as' (Name | String))? 'from' String Attributes? Eos
 | 'export' {ts("'type'? ")}'{{' (ExportSpec (',' ExportSpec)* ','?)? '}}' ('from' String Attributes?)? Eos
 {ts("| 'export' '=' Assign Eos | 'export' 'as' 'namespace' Id Eos | 'export' 'import' 'type'? Id '=' ('require' '(' String ')' | EntityName) Eos")}
 | Decorator* 'export' (Declaration | VarStatement)
ExportSpec <- {ts("'type' ExportSpecPlain !Name | ")}ExportSpecPlain
ExportSpecPlain <- (Name | String) ('as' (Name | String))?

Statement <- Block | ';' | Declaration | VarStatement | If | For | While | Do | Switch | Try
 | 'return' ?fn (^!nl Expr)? Eos | 'throw' ^!nl Expr Eos | 'break' (^!nl Id | ?brk) Eos | 'continue' (^!nl Id | ?loop) Eos | 'debugger' Eos
 | Id ':' Statement | ExprStatement
ExprStatement <- !/(?:function|class)(?![\w$])/ !'{{' !('let' '[') Expr Eos
Block <- '{{' BlockItem* '}}'
BlockItem <- Statement
Declaration <- Function | Class {ts("| Interface | TypeAlias | Enum | Namespace | Declare | 'abstract' ^!nl Class")}
VarStatement <- VarDecls Eos {ts("| 'await'? 'using' ^!nl VarDecl (',' VarDecl)* Eos")}
VarDecl <- Id {ts("'!'? ")}TypeNote? ('=' Assign)? | (ArrayBinding | ObjectBinding) TypeNote? '=' Assign
ConstDecl <- Binding TypeNote? '=' Assign {ts("| Id TypeNote")}
Binding <- Id | ArrayBinding | ObjectBinding
ArrayBinding <- '[' (',' | BindingElement (',' | &']'))* ('...' Binding)? ']'
BindingElement <- Binding ('=' Assign)?
ObjectBinding <- '{{' (BindingProperty (',' BindingProperty)* ','?)? '}}'
BindingProperty <- '...' Binding | PropertyName ':' BindingElement | Id ('=' Assign)?
If <- 'if' '(' Expr ')' Within ('else' Within)?
Within <- !/(?:class|const|function)(?![\w$])/ !('let' (Name | '[' | '{{')) !('async' ^!nl 'function') Statement
While <- 'while' '(' Expr ')' @loop(Within)
Do <- 'do' @loop(Within) 'while' '(' Expr ')' ';'?
For <- 'for' 'await'? '(' ForHead ')' @loop(Within)
ForHead <- /(?:var|let|const)(?![\w$])/ Binding TypeNote? ('of' Assign | 'in' Expr) &')'
 | LeftSide ('of' Assign | 'in' Expr) &')'
 | (VarDecls | Expr)? ';' Expr? ';' Expr?
VarDecls <- 'const' ConstDecl (',' ConstDecl)* | /(?:var|let)(?![\w$])/ VarDecl (',' VarDecl)*
Switch <- 'switch' '(' Expr ')' '{{' @switch(Case*) '}}'
Case <- ('case' Expr | 'default') ':' Statement*
Try <- 'try' Block ('catch' ('(' Binding TypeNote? ')')? Block ('finally' Block)? | 'finally' Block)

Function <- ('async' ^!nl)? 'function' '*'? Id? Signature (FunctionBody {ts("| Eos")})
FunctionBody <- @fn(Block)
Signature <- {ts("TypeParams? ")}'(' Params ')' {ts("ReturnType?")}
Params <- (Param (',' Param)* (',' Rest)? ','?)? | Rest
Param <- Decorator* {ts("Modifier* ")}(Binding {ts("| 'this'")}) {ts("'?'? ")}TypeNote? ('=' Assign)?
Rest <- Decorator* '...' Binding TypeNote?
Modifier <- /(?:public|private|protected|readonly|override|static|abstract|declare|accessor)(?![\w$])/ ^!nl &(Name | '[' | '#' | '{{' | String | Number | '*')
Class <- Decorator* 'class' (!Heritage Id)? {ts("TypeParams? ")}Heritage* '{{' @cls(Member*) '}}'
Heritage <- 'extends' LeftSide {ts("TypeArgs? (',' LeftSide)* | 'implements' Type (',' Type)*")}
Member <- ';' | 'static' FunctionBody
 | Decorator* {ts("Modifier*", "('static' &(PropertyName | '*' | '#'))?")} MemberTail
MemberTail <- ('get' PropertyName '(' ')' | 'set' PropertyName '(' Param ','? ')') {ts("ReturnType? ")}(FunctionBody {ts("| Eos")})
 | ('async' ^!nl)? '*'? PropertyName {ts("'?'? ")}Signature (FunctionBody {ts("| Eos")})
 {ts("| '[' Id ':' Type ']' TypeNote Eos")}
 | {ts("'accessor'? ")}PropertyName {ts("('?' | '!')? ")}TypeNote? ('=' Assign)? Eos
PropertyName <- Name | String | Number | '[' Assign ']' | "#" Name
Decorator <- '@' ('(' Expr ')' | Name ('.' Name)* {ts("TypeArgs? ")}Args?)

Expr <- Assign (',' Assign)*
Assign <- Arrow | Yield | (Pattern | Target) AssignOp Assign | Cond
AssignOp <- '=' | /(?:\*\*|\+|-|\*|\/|%|<<|>>>|>>|&&|\|\||\?\?|&|\^|\|)=/
Yield <- 'yield' (^!nl '*'? Assign)?
Pattern <- (ArrayPattern | ObjectPattern) &('=' | 'of' | 'in' | ')' | ',' | ']' | '}}')
ArrayPattern <- '[' (',' | PatternElement (',' | &']'))* ('...' PatternTarget)? ']'
PatternElement <- PatternTarget ('=' Assign)?
PatternTarget <- Pattern | LeftSide
ObjectPattern <- '{{' (PatternProperty (',' PatternProperty)* ','?)? '}}'
PatternProperty <- '...' LeftSide | PropertyName ':' PatternElement | Id ('=' Assign)?
Target <- !(Number | String | Template | /(?:true|false|null|this)(?![\w$])(?!\s*[.\[])/) LeftSide
Arrow <- ('async' ^!nl)? (Id | Signature) ^!nl '=>' (FunctionBody | !'{{' Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (BinaryOp Unary {ts("| ^!nl ('as' | 'satisfies') Type")})*
BinaryOp <- /(?:===|!==|==|!=|<=|>=|<<|>>>|>>|&&|\|\||\?\?|\*\*|[+\-*\/%&|^<>])(?!=)/ | /(?:in|instanceof)(?![\w$])/ | /<=|>=|===|!==|==|!=/
Unary <- 'delete' !(Id !Suffix) Unary | PrefixOp Unary {ts("| '<' Type '>' Unary" if not markup else "")} | Postfix
PrefixOp <- '++' | '--' | '+' | '-' | '!' | '~' | /(?:typeof|void|await)(?![\w$])/
Postfix <- LeftSide (^!nl ('++' | '--'))?
LeftSide <- Head Suffix*
Head <- New | 'super' &('(' | '.' | '[') | Primary
New <- 'new' '.' 'target' | 'new' (New | Primary) MemberSuffix* {ts("TypeArgs? ")}Args?
MemberSuffix <- '.' '#'? Name | '[' Expr ']' | Template {ts("| '!' ^!nl")}
Suffix <- '?.' (Args | '[' Expr ']' | "#" Name | Name {ts("| TypeArgs Args")}) | '.' "#" Name | '.' Name | '[' Expr ']' | Args | Template
 {ts("| TypeArgs (Args | Template | &(')' | ']' | ':' | ';' | ',' | '.' | '}')) | ^!nl '!'")}
Args <- '(' (Argument (',' Argument)* ','?)? ')'
Argument <- '...'? Assign
Primary <- Function | Class | 'import' (Args | '.' 'meta') | Id | Number | String | Template | Array | Object | '(' Expr ')'
 | /(?:this|null|true|false)(?![\w$])/ | Regex {"| Markup" if markup else ""} | "#" Name &'in'
Array <- '[' (',' | '...'? Assign (',' | &']'))* ']'
Object <- '{{' (Property (',' Property)* ','?)? '}}'
Property <- '...' Assign | ('get' PropertyName '(' ')' | 'set' PropertyName '(' Param ','? ')') {ts("ReturnType? ")}FunctionBody
 | ('async' ^!nl)? '*'? PropertyName Signature FunctionBody
 | PropertyName ':' Assign | Id
TypeNote <- {ts("':' Type", "!/[\\s\\S]/ &/x/")}
{_TYPES if types else ""}
{_MARKUP.replace("@TA@", "TypeArgs?" if types else "") if markup else ""}
"""


_TYPES = r"""
ReturnType <- ':' ('asserts' (Id | 'this') ('is' Type)? !Name | (Id | 'this') 'is' Type | Type)
TypeParams <- '<' TypeParam (',' TypeParam)* ','? ">"
TypeParam <- ('const' | 'in' &Name | 'out' &Name)* Id ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* ','? ">"
Type <- FunctionType | Union ('extends' Type '?' Type ':' Type)?
FunctionType <- 'abstract'? 'new'? TypeParams? '(' Params ')' '=>' (('asserts' (Id | 'this') ('is' Type)? | (Id | 'this') 'is' Type) | Type)
Union <- '|'? Intersection ('|' Intersection)*
Intersection <- '&'? TypeOperator ('&' TypeOperator)*
TypeOperator <- ('keyof' | 'unique' | 'readonly') TypeOperator | 'infer' Id ('extends' Union !'?')? | FunctionType | PostfixType
PostfixType <- PrimaryType (^!nl '[' Type? ']')*
PrimaryType <- '(' Type ')' | Mapped | ObjectType | Tuple | 'typeof' ('import' '(' Type ')' | Id | 'this') ('.' Name)* TypeArgs?
 | 'import' '(' Type (',' Object)? ')' ('.' Name)* TypeArgs? | '-'? Number | String | TypeTemplate | /(?:this|null|true|false|void)(?![\w$])/ | EntityName TypeArgs?
TypeTemplate <- Whole | "`" (TemplateText | /\$\{/ Type HoleEnd)* "`"
EntityName <- Id ('.' Name)*
Tuple <- '[' (TupleItem (',' TupleItem)* ','?)? ']'
TupleItem <- '...'? Name '?'? ':' Type | '...'? Type '?'?
ObjectType <- '{' (TypeMember ((';' | ',') | &'}' | ^nl))* '}'
TypeMember <- ('get' | 'set') PropertyName '(' Params ')' ReturnType? | 'new'? Signature
 | ('readonly' &(Name | '[' | String))? '[' Id ':' Type ']' TypeNote | ('readonly' &(Name | '[' | String | Number))? PropertyName '?'? (Signature | TypeNote)?
Mapped <- '{' (('+' | '-')? 'readonly')? '[' Id 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? TypeNote? (';' | ',')? '}'
Interface <- 'interface' Id TypeParams? ('extends' Type (',' Type)*)? ObjectType
TypeAlias <- 'type' ^!nl Id TypeParams? '=' Type Eos
Enum <- 'const'? 'enum' Id '{' (EnumMember (',' EnumMember)* ','?)? '}'
EnumMember <- PropertyName ('=' Assign)?
Namespace <- ('namespace' | 'module') ^!nl (EntityName | String) ('{' ModuleItem* '}' | Eos) | 'global' '{' ModuleItem* '}'
Declare <- 'declare' ^!nl (Function | Class | 'abstract' Class | Interface | TypeAlias | Enum | Namespace | VarStatement)
"""

_MARKUP = r"""
Markup <- '<' $TagName @TA@ Attribute* ('/' ">" | CloseOpen Child* '<' '/' =TagName ">") | '<' FragmentOpen Child* '<' '/' ">"
FragmentOpen <- ">"
CloseOpen <- />/
TagName <- /[A-Za-z_$][\w$\-]*(?:[:.][A-Za-z_$][\w$\-]*)*/
Attribute <- '{' '...' Assign '}' | /[A-Za-z_$][\w$\-]*(?::[A-Za-z_$][\w$\-]*)?/ ('=' (/"[^"]*"/ | /'[^']*'/ | '{' Assign '}' | Markup))?
Child <- /[^<{}>]++/ | '{' ('...'? Expr)? '}' | Markup
"""

GO = r"""
File <- 'package' Id Eos (ImportDecl Eos)* (TopDecl Eos)*
Eos <- ';' | &(')' | '}') | ^nl | !/[\s\S]/
Id <- /(?!(?:break|case|chan|const|continue|default|defer|else|fallthrough|for|func|go|goto|if|import|interface|map|package|range|return|select|struct|switch|type|var)(?!\w))[^\W\d]\w*+/
String <- /"(?:[^"\\\n]|\\.)*+"/ | /`[^`]*+`/
Number <- /(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+\-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+\-]?\d[\d_]*)?)i?(?!\w)/
Rune <- /'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'/
ImportDecl <- 'import' ('(' (ImportSpec Eos)* ')' | ImportSpec)
ImportSpec <- ('.' | Id)? String
TopDecl <- Decl | Func
Decl <- 'const' (ConstGroup | ConstSpec) | 'var' (VarGroup | VarSpec) | 'type' ('(' (TypeSpec Eos)* ')' | TypeSpec)
ConstGroup <- '(' (ConstSpec Eos)* ')'
ConstSpec <- Ids (Type? '=' Exprs)?
VarGroup <- '(' (VarSpec Eos)* ')'
VarSpec <- Ids (Type ('=' Exprs)? | '=' Exprs)
Ids <- Id (',' Id)*
TypeSpec <- Id (TypeParams Type | '=' Type | Type)
TypeParams <- '[' Ids Constraint (',' Ids Constraint)* ','? ']'
Constraint <- TypeTerm ('|' TypeTerm)*
TypeTerm <- '~'? Type
Func <- 'func' ('(' Params ')')? Id TypeParams? Signature @fn(Block)?
Signature <- '(' Params ')' Result?
Result <- '(' Params ')' | Type
Params <- (Param (',' Param)* Last)?
Last <- ',' | ^!nl
Param <- Id '...'? Type | '...' Type | Type
Type <- '(' Type ')' | '*' Type | '[' ']' Type | '[' ('...' | Expr) ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type
 | 'func' Signature | Struct | Interface | TypeName
TypeName <- Id ('.' Id)? (^!nl '[' Type (',' Type)* ','? ']')?
Struct <- 'struct' '{' (Field Eos)* '}'
Field <- (Ids Type | '*'? TypeName) String?
Interface <- 'interface' '{' (InterfaceItem Eos)* '}'
InterfaceItem <- Id Signature | Constraint
Block <- '{' Statements '}'
Statements <- (Statement Eos | ';')* Statement?
Statement <- Decl | Id ':' !'=' Statement? | Block | If | For | Switch | Select
 | 'return' (^!nl Exprs)? | 'break' (^!nl Id | ?brk) | 'continue' (^!nl Id | ?loop) | 'goto' Id | 'fallthrough' | ('go' | 'defer') Expr | Simple
Simple <- Exprs (^!nl (AssignOp Exprs | '++' | '--' | '<-' Expr))?
AssignOp <- ':=' | '=' | /(?:\+|-|\*|\/|%|&\^|&|\||\^|<<|>>)=/
Exprs <- Expr (',' Expr)*
If <- 'if' (HeadSimple? ';')? HeadExpr Block (^!nl 'else' (If | Block))?
For <- 'for' (HeadRange | HeadSimple? ';' HeadExpr? ';' HeadSimple? | HeadExpr)? @loop(Block)
HeadRange <- (HeadExprs (':=' | '='))? 'range' HeadExpr
Switch <- 'switch' ((HeadSimple? ';')? (TypeGuard | HeadExpr)?) '{' @switch(SwitchCase*) '}'
TypeGuard <- (Id ':=')? HeadPrimary '.' '(' 'type' ')'
SwitchCase <- ('case' CaseItem (',' CaseItem)* | 'default') ':' Statements
CaseItem <- Expr | Type
Select <- 'select' '{' @switch(SelectCase*) '}'
SelectCase <- ('case' Simple | 'default') ':' Statements
HeadSimple <- HeadExprs (^!nl AssignOp HeadExprs | '++' | '--' | '<-' HeadExpr)?
HeadExprs <- HeadExpr (',' HeadExpr)*
HeadExpr <- HeadUnary (^!nl BinaryOp HeadUnary)*
HeadUnary <- UnaryOp HeadUnary | HeadPrimary
HeadPrimary <- HeadOperand HeadSuffix*
HeadOperand <- LiteralType CompositeBody | 'func' Signature @fn(Block) | Number | Rune | String | Id | '(' (Expr | Type) ')' | ConversionType
HeadSuffix <- ^!nl ('.' '(' Type ')' | '.' Id | Index | Call)
Expr <- Unary (^!nl BinaryOp Unary)*
BinaryOp <- /&&|\|\||==|!=|<=|>=|<<(?!=)|>>(?!=)|&\^(?!=)|(?:[+\-*\/%&|^])(?![=])(?!\+\+)|<(?!-)|>/
Unary <- UnaryOp Unary | Primary
UnaryOp <- '+' | '-' | '!' | '^' | '*' | '&' | '<-'
Primary <- Operand Suffix*
Operand <- LiteralType CompositeBody | 'func' Signature @fn(Block) | Number | Rune | String | TypeName CompositeBody | Id | '(' (Expr | Type) ')' | ConversionType
LiteralType <- '[' '...' ']' Type | '[' Expr? ']' Type | 'map' '[' Type ']' Type | Struct
ConversionType <- '[' Expr? ']' Type | 'map' '[' Type ']' Type | 'chan' Type | Interface | 'func' Signature | Struct
CompositeBody <- '{' (Element (',' Element)* Last)? '}'
Element <- ElementValue (':' ElementValue)?
ElementValue <- CompositeBody | Expr
Suffix <- ^!nl ('.' '(' ('type' | Type) ')' | '.' Id | Index CompositeBody? | Call)
Index <- '[' (Expr? ':' Expr? (':' Expr)? | (Type | Expr) (',' (Type | Expr))* ','?) ']'
Call <- '(' (CallArg (',' CallArg)* Last)? ')'
CallArg <- Expr '...'? | Type
"""
_GO_OPERATORS = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( ) [ ] { } , ; . : ~"

JAVA = r"""
Unit <- (Annotation* 'package' Qualified ';')? (Import | ';')* (Module | (TypeDecl | ';')*)
Module <- Annotation* 'open'? 'module' Qualified '{' /[^}]*/ '}'
Id <- /(?!(?:abstract|assert|boolean|break|byte|case|catch|char|class|const|continue|default|do|double|else|enum|extends|final|finally|float|for|goto|if|implements|import|instanceof|int|interface|long|native|new|package|private|protected|public|return|short|static|strictfp|super|switch|synchronized|this|throw|throws|transient|try|void|volatile|while|true|false|null|_)(?![\w$]))[^\W\d][\w$]*+|(?!\w)\$[\w$]*+/
Qualified <- Id ('.' Id)*
Import <- 'import' 'static'? Qualified ('.' '*')? ';'
Annotation <- '@' !'interface' Qualified ('(' (ElementPair (',' ElementPair)* | ElementValue)? ')')?
ElementPair <- Id '=' ElementValue
ElementValue <- Annotation | '{' (ElementValue (',' ElementValue)*)? ','? '}' | Cond
Modifier <- Annotation | /(?:public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|non-sealed)(?![\w$:])/ | 'sealed' &(Modifier | 'class' | 'interface' | 'abstract')
TypeDecl <- Modifier* (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | AnnotationDecl)
ClassDecl <- 'class' $Id TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? '{' @cls(Member*) '}'
InterfaceDecl <- 'interface' Id TypeParams? ('extends' Types)? ('permits' Types)? ClassBody
AnnotationDecl <- '@' 'interface' Id ClassBody
EnumDecl <- 'enum' $Id ('implements' Types)? '{' (EnumConstant (',' EnumConstant)*)? ','? (';' @cls(Member*))? '}'
EnumConstant <- Annotation* Id Args? ClassBody?
RecordDecl <- 'record' $Id TypeParams? '(' Params ')' ('implements' Types)? '{' @cls(Member*) '}'
ClassBody <- '{' @cls(Member*) '}'
Member <- ';' | 'static'? @fn(Block) | Modifier* (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | AnnotationDecl | MethodDecl | FieldDecl)
MethodDecl <- TypeParams? Annotation* (('void' | Type) Id | ~Id) '(' Params ')' Dims ('throws' Types)? ('default' ElementValue)? (@fn(Block) | ';') | ~Id @fn(Block)
FieldDecl <- Type VarDecls ';'
VarDecls <- VarDecl (',' VarDecl)*
VarDecl <- Id Dims ('=' (ArrayInit | Expr))?
Dims <- (Annotation* '[' ']')*
ArrayInit <- '{' (ArrayItem (',' ArrayItem)*)? ','? '}'
ArrayItem <- ArrayInit | Expr
Params <- (Param (',' Param)*)?
Param <- Modifier* Type (Annotation* '...')? (Id | (Id '.')? 'this') Dims
Types <- Type (',' Type)*
Type <- Annotation* (Primitive | ClassType) (Annotation* '[' ']')*
Primitive <- /(?:boolean|byte|short|int|long|char|float|double)(?![\w$])/
ClassType <- Id TypeArgs? ('.' Annotation* Id TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? ">"
TypeArg <- Annotation* '?' (('extends' | 'super') Type)? | Type
TypeParams <- '<' TypeParam (',' TypeParam)* ">"
TypeParam <- Annotation* Id ('extends' Type ('&' Type)*)?
Block <- '{' BlockItem* '}'
BlockItem <- LocalClass | LocalVar ';' | Statement
LocalClass <- (Annotation | 'final' | 'abstract' | 'static' | 'strictfp' | 'sealed')* (ClassDecl | RecordDecl | InterfaceDecl | EnumDecl)
LocalVar <- (Annotation | 'final')* !('yield' | 'return' | 'throw' | 'new' | 'assert' | 'else' | 'case') Type VarDecls
Statement <- Block | ';' | 'if' '(' Expr ')' Statement ('else' Statement)? | 'while' '(' Expr ')' @loop(Statement) | 'do' @loop(Statement) 'while' '(' Expr ')' ';'
 | For | 'switch' '(' Expr ')' SwitchBody | Try | 'synchronized' '(' Expr ')' Block | 'return' Expr? ';' | 'throw' Expr ';'
 | 'break' (Id | ?brk) ';' | 'continue' (Id | ?loop) ';' | 'assert' Expr (':' Expr)? ';' | 'yield' !('=' | '.' | '(' | '++' | '--') Expr ';' | Id ':' Statement | ExprStatement
ExprStatement <- (('++' | '--') Unary | Target AssignOp Expr | Postfix ('++' | '--') | 'new' Creator Suffix* | Primary (Suffix &Suffix)* Args) ';'
For <- 'for' '(' (((Annotation | 'final')* Type Id Dims ':' Expr) | ForInit? ';' Expr? ';' (Expr (',' Expr)*)?) ')' @loop(Statement)
ForInit <- LocalVar | Expr (',' Expr)*
Try <- 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? | Block (Catch+ Finally? | Finally))
Resource <- (Annotation | 'final')* Type Id '=' Expr | Postfix
Catch <- 'catch' '(' (Annotation | 'final')* Type ('|' Type)* Id ')' Block
Finally <- 'finally' Block
SwitchBody <- '{' (@switch(ArrowCase+) | @switch(OldCase*)) '}'
ArrowCase <- CaseLabel '->' (Block | 'throw' Expr ';' | Expr ';')
OldCase <- (CaseLabel ':')+ BlockItem*
CaseLabel <- 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem <- 'default' | CasePattern | Cond
CasePattern <- (Annotation | 'final')* Type ('(' (CasePattern (',' CasePattern)*)? ')' | Id)
Expr <- Lambda | Target AssignOp Expr | Cond
AssignOp <- '=' | /(?:\+|-|\*|\/|%|&|\||\^|<<|>>>|>>)=/
Target <- Postfix
Lambda <- (Id | '(' (Id (',' Id)*)? ')' | '(' Params ')') '->' (@fn(Block) | Expr)
Cond <- Binary ('?' Expr ':' (Lambda | Cond))?
Binary <- Unary (BinaryOp Unary | 'instanceof' (CasePattern | Type))*
BinaryOp <- /&&|\|\||==|!=|<=|>=|<<(?!=)|>>>(?!=)|>>(?!=)|[+\-*\/%&|^](?![=])|[<>](?![=])/
Unary <- ('++' | '--' | '+' | '-' | '!' | '~') Unary | Cast | Postfix ('++' | '--')*
Cast <- '(' Primitive (Annotation* '[' ']')* ')' Unary | '(' Type ('&' Type)* ')' (Lambda | !('+' | '-') Unary)
Postfix <- Primary Suffix*
Suffix <- '.' 'new' Creator | '.' TypeArgs? (Id | 'super' | 'this' | 'class') | '[' Expr ']' | Args | '::' TypeArgs? (Id | 'new')
Primary <- '(' Expr ')' | Literal | 'this' | 'super' | 'new' Creator | 'switch' '(' Expr ')' SwitchBody | 'void' '.' 'class'
 | (Primitive | ClassType) ('[' ']')* ('.' 'class' | '::' (Id | 'new')) | Id
Creator <- TypeArgs? (Annotation* Primitive | Annotation* ClassType) (Args ClassBody? | ('[' ']')+ ArrayInit | (Annotation* '[' Expr ']')+ ('[' ']')*)
Args <- '(' (Expr (',' Expr)*)? ')'
Literal <- /(?:true|false|null)(?![\w$])/ | /""\"[ \t]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*+""\"/ | /"(?:[^"\\\n\r]|\\.)*+"/ | /'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'/
 | /(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+\-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+\-]?\d[\d_]*)?)[lLfFdD]?(?![\w$])/
"""
_JAVA_OPERATORS = "( ) { } [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << >> >>> += -= *= /= &= |= ^= %= <<= >>= >>>="

RUST = r"""
File <- Shebang? InnerAttr* Item*
Shebang <- /#!(?!\s*\[)[^\n]*/
Id <- /(?!(?:as|break|const|continue|crate|else|enum|extern|false|fn|for|if|impl|in|let|loop|match|mod|move|mut|pub|ref|return|self|Self|static|struct|super|trait|true|type|unsafe|use|where|while|async|await|dyn|abstract|become|box|do|final|macro|override|priv|typeof|unsized|virtual|yield|try)(?!\w))(?!r#*")[^\W\d]\w*+|r#[^\W\d]\w*+/
Lifetime <- /'(?:[^\W\d]\w*)(?!')/
String <- /b?"(?:[^"\\]|\\[\s\S])*+"/ | /c"(?:[^"\\]|\\[\s\S])*+"/ | /[bc]?r(#*)"[\s\S]*?"\1(?!#)/
Char <- /b?'(?:[^'\\\n]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'/
Number <- /(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?!\.|[^\W\d])\d[\d_]*|\.(?!\.|\w))?(?:[eE][+\-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)/
InnerAttr <- '#' '!' '[' Tokens ']'
Attr <- '#' '[' Tokens ']'
Tokens <- (Token)*
Token <- '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' | String | Char | Lifetime | Number | /[^\W\d]\w*+/ | /[^\s()\[\]{}"'\w]/ 
Item <- Attr* (MacroRules | Vis? ItemKind | MacroItem)
Vis <- 'pub' ('(' ('crate' | 'self' | 'super' | 'in' Path) ')')?
ItemKind <- Mod | ExternCrate | Use | FnItem | TypeItem | Struct | EnumItem | Union | ConstItem | StaticItem | Trait | Impl | ExternBlock
Mod <- 'unsafe'? 'mod' Id (';' | '{' InnerAttr* Item* '}')
ExternCrate <- 'extern' 'crate' (Id | 'self') ('as' (Id | '_'))? ';'
Use <- 'use' UseTree ';'
UseTree <- '::'? (UsePath '::')? ('*' | '{' (UseTree (',' UseTree)* ','?)? '}') | '::'? UsePath ('as' (Id | '_'))?
UsePath <- Segment ('::' Segment)*
Segment <- Id | 'self' | 'super' | 'crate'
FnItem <- FnQual 'fn' Id Generics? '(' FnParams ')' ('->' Type)? Where? (@fn(Block) | ';')
FnQual <- ('const' | 'async' | 'unsafe' | 'safe' | 'extern' String?)*
FnParams <- (FnParam (',' FnParam)* ','?)?
FnParam <- Attr* (('&' Lifetime?)? 'mut'? 'self' (':' Type)? | '...' | Pattern ':' ('...' | Type) | Type)
TypeItem <- 'default'? 'type' Id Generics? (':' Bounds?)? Where? ('=' Type Where?)? ';'
Struct <- 'struct' Id Generics? (Where? '{' Fields '}' | '(' TupleFields ')' Where? ';' | Where? ';')
Union <- 'union' Id Generics? Where? '{' Fields '}'
Fields <- (Field (',' Field)* ','?)?
Field <- Attr* Vis? Id ':' Type
TupleFields <- (TupleField (',' TupleField)* ','?)?
TupleField <- Attr* Vis? Type
EnumItem <- 'enum' Id Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
Variant <- Attr* Vis? Id ('{' Fields '}' | '(' TupleFields ')')? ('=' Expr)?
ConstItem <- 'default'? 'const' (Id | '_') ':' Type ('=' Expr)? ';'
StaticItem <- 'static' 'mut'? Id ':' Type ('=' Expr)? ';'
Trait <- 'unsafe'? 'auto'? 'trait' Id Generics? (':' Bounds?)? Where? '{' InnerAttr* Assoc* '}'
Assoc <- Attr* (Vis? 'default'? (FnItem | TypeItem | ConstItem) | MacroItem)
Impl <- 'default'? 'unsafe'? 'impl' Generics? 'const'? ('!'? Type 'for')? Type Where? '{' InnerAttr* Assoc* '}'
ExternBlock <- 'unsafe'? 'extern' String? '{' InnerAttr* (Attr* (Vis? (FnItem | StaticItem | TypeItem) | MacroItem))* '}'
MacroRules <- 'macro_rules' '!' Id ('{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';')
MacroItem <- Path '!' ('{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';')
Generics <- '<' (GenericParam (',' GenericParam)* ','?)? ">"
GenericParam <- Attr* (Lifetime (':' LifetimeBounds?)? | 'const' Id ':' Type ('=' (Block | '-'? Literal | Id))? | Id (':' Bounds?)? ('=' Type)?)
LifetimeBounds <- Lifetime ('+' Lifetime)* '+'?
Where <- 'where' (WhereItem (',' WhereItem)* ','?)?
WhereItem <- Lifetime ':' LifetimeBounds? | ForLifetimes? Type ':' Bounds?
ForLifetimes <- 'for' Generics
Bounds <- Bound ('+' Bound)* '+'?
Bound <- Lifetime | '(' Bound ')' | '~'? 'const'? '?'? ForLifetimes? Path | 'use' Generics
Type <- '(' (Type (',' Type)* ','?)? ')' | '!' | '*' ('const' | 'mut') Type | '&' Lifetime? 'mut'? Type | '&&' Lifetime? 'mut'? Type | '[' Type (';' Expr)? ']'
 | '_' | ForLifetimes? FnQual 'fn' '(' FnTypeParams ')' ('->' Type)? | 'impl' Bounds | 'dyn' Bounds | QualifiedPath | Path ('!' ('(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}'))? ('+' Bounds)?
FnTypeParams <- (FnTypeParam (',' FnTypeParam)* ','?)?
FnTypeParam <- Attr* ((Id | '_') ':' !':')? ('...' | Type)
QualifiedPath <- '<' Type ('as' Path)? ">" ('::' PathSegment)+
Path <- '::'? PathSegment ('::' PathSegment)*
PathSegment <- (Id | 'self' | 'Self' | 'super' | 'crate') ('::'? GenericArgs | '(' (Type (',' Type)* ','?)? ')' ('->' Type)?)?
GenericArgs <- '<' (GenericArg (',' GenericArg)* ','?)? ">"
GenericArg <- Lifetime | Id GenericArgs? '=' Type | Id GenericArgs? ':' Bounds | Type !'=' | Block | '-'? Literal
Block <- '{' InnerAttr* StmtItem* Expr? '}'
StmtItem <- ';' | Attr* Let | !ExprMacro Item | Attr* BlockLike !('.' | '?') | Attr* MacroStmt | Attr* Expr ';'
ExprMacro <- Path '!' ('(' Tokens ')' | '[' Tokens ']') !';'
MacroStmt <- Path '!' '{' Tokens '}' !('.' | '?')
Let <- 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';'
BlockLike <- (Lifetime ':')? ('unsafe' Block | Block | IfExpr | MatchExpr | Loop | 'async' 'move'? Block | 'const' Block)
IfExpr <- 'if' HeadExpr Block ('else' (IfExpr | Block))?
MatchExpr <- 'match' HeadExpr '{' InnerAttr* (MatchArm)* '}'
MatchArm <- Attr* '|'? Pattern ('|' Pattern)* ('if' Expr)? '=>' (BlockLike ','? &ArmEnd | Expr (',' | &'}'))
ArmEnd <- !('.' | '?')
Loop <- 'loop' @loop(Block) | 'while' HeadExpr @loop(Block) | 'for' Pattern 'in' HeadExpr @loop(Block)
Pattern <- '|'? PatternOne ('|' PatternOne)*
PatternOne <- RangePattern | '&&'? '&'? &('&' | 'mut' | 'ref') '&'? 'mut'? PatternOne | '&' PatternOne | '&&' PatternOne | 'box' PatternOne | ('ref' &(Id | 'mut'))? 'mut'? Id !('::' | '(' | '{' | '!' | '<') ('@' PatternOne)?
 | '(' (PatternItem (',' PatternItem)* ','?)? ')' | '[' (PatternItem (',' PatternItem)* ','?)? ']' | '-'? Literal | '_' | '..' !'=' | (QualifiedPath | Path) ('{' (FieldPattern (',' FieldPattern)* ','?)? '}' | '(' (PatternItem (',' PatternItem)* ','?)? ')' | '!' ('(' Tokens ')' | '[' Tokens ']'))?
PatternItem <- Attr* Pattern
RangePattern <- RangeEnd ('..=' | '...') RangeEnd | RangeEnd '..' RangeEnd? | '..=' RangeEnd
RangeEnd <- '-'? Literal | Path
FieldPattern <- Attr* ('..' | (Id | Number) ':' Pattern | 'ref'? 'mut'? Id)
Literal <- String | Char | Number | /(?:true|false)(?!\w)/
Expr <- Closure | Jump | Assignment
Jump <- 'return' Expr? | 'break' Lifetime? (!'{' Expr)? | 'continue' Lifetime? | 'yield' Expr?
Closure <- ForLifetimes? 'static'? 'async'? 'move'? ('||' | '|' (ClosureParam (',' ClosureParam)* ','?)? '|') ('->' Type Block | Expr)
ClosureParam <- Attr* PatternOne (':' Type)?
Assignment <- Range (('=' | /(?:\+|-|\*|\/|%|&|\||\^|<<|>>)=/) Expr)?
Range <- ('..=' | '..') Binary? | Binary (('..=' | '..') Binary?)?
Binary <- Unary (BinaryOp Unary | 'as' Type)*
BinaryOp <- /&&|\|\||==|!=|<=|>=|<<(?!=)|>>(?!=)|[+\-*\/%^](?![=])|&(?![&=])|\|(?![|=])|[<>](?![=])/
Unary <- ('-' | '!' | '*' | '&&' | '&') (('raw' ('const' | 'mut')) | 'mut')? Unary | Closure | Jump | Postfix
Postfix <- Primary Suffix*
Suffix <- '?' | '.' 'await' | '.' Id ('::' GenericArgs)? '(' Exprs ')' | '.' (Id | Number) | '(' Exprs ')' | '[' Expr ']'
Exprs <- (Attr* Expr (',' Attr* Expr)* ','?)?
Primary <- Literal | BlockLike | '(' Exprs ')' | '[' (Expr ';' Expr | Exprs) ']' | 'let' Pattern '=' Unary | MacroCall | StructExpr | QualifiedPath | ExprPath
MacroCall <- Path '!' ('(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}')
ExprPath <- '::'? ExprSegment ('::' ExprSegment)*
ExprSegment <- (Id | 'self' | 'Self' | 'super' | 'crate') ('::' GenericArgs)?
StructExpr <- ExprPath '{' (FieldInit (',' FieldInit)* ','?)? ('..' Expr?)? '}'
FieldInit <- Attr* ((Id | Number) ':' Expr | Id !':') | '..' Expr
HeadExpr <- HeadAssign
HeadAssign <- HeadRange
HeadRange <- ('..=' | '..') HeadBinary? | HeadBinary (('..=' | '..') HeadBinary?)?
HeadBinary <- HeadUnary (BinaryOp HeadUnary | 'as' Type)*
HeadUnary <- ('-' | '!' | '*' | '&&' | '&') 'mut'? HeadUnary | Closure | 'let' Pattern '=' HeadUnary | HeadPostfix
HeadPostfix <- HeadPrimary Suffix*
HeadPrimary <- Literal | BlockLikeHead | '(' Exprs ')' | '[' (Expr ';' Expr | Exprs) ']' | MacroCall | QualifiedPath | ExprPath
BlockLikeHead <- 'unsafe' Block | IfExpr | MatchExpr | Loop | Block
"""
_RUST_OPERATORS = "+ - * / % ^ ! & | && || << >> += -= *= /= %= ^= &= |= <<= >>= = == != > < >= <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { }"
_RUST_TRIVIA = r"\s+|//[^\n]*+|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/"


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """ts, tsx, js, jsx, go, java or rs."""
    if language in ("ts", "tsx", "js", "jsx"):
        text = _ecmascript(types=language in ("ts", "tsx"), markup=language in ("tsx", "jsx"))
        return Grammar(text, trivia=r"[\s﻿]+|" + _C_TRIVIA[4:], operators=_JS_OPERATORS)
    text, trivia, operators = {"go": (GO, _C_TRIVIA, _GO_OPERATORS), "java": (JAVA, _C_TRIVIA, _JAVA_OPERATORS), "rs": (RUST, _RUST_TRIVIA, _RUST_OPERATORS)}[language]
    return Grammar(text, trivia=trivia, operators=operators, words=r"\w")


# Python: line structure is made explicit first; \x01 ends a logical line, \x02 and \x03 open and close a block.
PYTHON = r"""
File <- Statement* !/[\s\S]/
NL <- /\x01/
Indent <- /\x02/
Dedent <- /\x03/
Name <- /(?!(?:False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield)(?!\w))[^\W\d]\w*+/
Number <- /(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?)(?!\w)/
String <- /[rRbBuUfFtT]{0,2}(?:""\"(?:[^"\\]|\\[\s\S]|"(?!""))*+""\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')/
Statement <- Compound | SimpleLine
SimpleLine <- Simple (';' Simple)* ';'? NL
Block <- NL Indent Statement+ Dedent | SimpleLine
Simple <- TypeAlias &End | Assignment &End | Import | Return | Raise | 'pass' | Del | 'assert' Expr (',' Expr)? | 'break' ?loop | 'continue' ?loop
 | ('global' | 'nonlocal') Name (',' Name)* | StarExprs
End <- ';' | NL
TypeAlias <- 'type' Name TypeParams? '=' Expr
Assignment <- &/[^\x01;]*?[=:]/ (SingleSubscript | Name | '(' SingleTarget ')') ':' Expr ('=' Annotated)? | (StarTargets '=' !'=')+ Annotated | SingleTarget AugOp Annotated
Annotated <- Yield | StarExprs
AugOp <- /(?:\*\*|\/\/|>>|<<|[+\-*@\/%&|^])=/
SingleTarget <- SingleSubscript | Name | '(' SingleTarget ')'
SingleSubscript <- Chain
StarTargets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*'? TargetAtom
TargetAtom <- Chain | Name !('.' | '(' | '[') | '(' StarTargets? ')' !('.' | '[' | '(') | '[' StarTargets? ']' !('.' | '[' | '(')
Chain <- Atom ChainStep+
ChainStep <- Call* Access !'(' | Call+ Access | Access &'('
Access <- '.' Name | '[' Slices ']'
Return <- 'return' ?fn StarExprs?
Raise <- 'raise' (Expr ('from' Expr)?)?
Del <- 'del' DelTarget (',' DelTarget)* ','?
DelTarget <- Chain | Name | '(' (DelTarget (',' DelTarget)* ','?)? ')' | '[' (DelTarget (',' DelTarget)* ','?)? ']'
Import <- 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* | 'from' ('.' | '...')* (Dotted | &'import') 'import' ('*' | '(' ImportNames ','? ')' | ImportNames !',')
ImportNames <- Name ('as' Name)? (',' Name ('as' Name)?)*
Dotted <- Name ('.' Name)*
Compound <- Decorated | Function | Class | If | While | For | Try | With | Match
Decorated <- ('@' NamedExpr NL)+ (Function | Class)
Function <- 'async'? 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' @fn(Block)
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('**' | '*')? Name (':' Expr)? ('=' StarExpr)?
Params <- PlainParams (',' StarParams | ',' '/' (',' PlainParams)? (',' StarParams)? )? ','? &')' | StarParams ','? &')'
PlainParams <- PlainParam (',' PlainParam)*
PlainParam <- Name (':' Expr)? ('=' Expr)?
StarParams <- '*' (Name (':' StarExpr)? | &',') (',' PlainParam)* (',' KwParam)? | KwParam
KwParam <- '**' Name (':' Expr)?
Class <- 'class' Name TypeParams? ('(' Args? ')')? ':' @cls(Block)
If <- 'if' NamedExpr ':' Block ('elif' NamedExpr ':' Block)* Else?
Else <- 'else' ':' Block
While <- 'while' NamedExpr ':' @loop(Block) Else?
For <- 'async'? 'for' StarTargets 'in' StarExprs ':' @loop(Block) Else?
Try <- 'try' ':' Block ('finally' ':' Block | Except+ Else? ('finally' ':' Block)?)
Except <- 'except' '*'? (Expr (',' Expr)* ('as' Name)?)? ':' Block
With <- 'async'? 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' | WithItem (',' WithItem)* ':') Block
WithItem <- Expr ('as' StarTarget)? &(',' | ')' | ':')
Match <- 'match' MatchSubject ':' NL Indent CaseBlock+ Dedent
MatchSubject <- StarExprs | NamedExpr
CaseBlock <- 'case' Patterns ('if' NamedExpr)? ':' Block
Patterns <- MaybeStar (',' MaybeStar)* ','?
MaybeStar <- '*' Name | AsPattern
AsPattern <- OrPattern ('as' Name)?
OrPattern <- ClosedPattern ('|' ClosedPattern)*
ClosedPattern <- '-'? Number (('+' | '-') Number)? | String+ | 'None' | 'True' | 'False' | Dotted '(' (PatternArg (',' PatternArg)* ','?)? ')' | Dotted | '(' (Patterns)? ')' | '[' Patterns? ']'
 | '{' (PatternItem (',' PatternItem)* ','?)? '}'
PatternArg <- Name '=' AsPattern | AsPattern
PatternItem <- '**' Name | (Dotted | '-'? Number | String+ | 'None' | 'True' | 'False') ':' AsPattern
StarExprs <- Yield | StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr | NamedExpr
NamedExpr <- Expr !':=' | Name ':=' Expr
Yield <- 'yield' ?fn ('from' Expr | StarExprs)?
Expr <- Lambda | Disjunction ('if' Disjunction 'else' Expr)?
Lambda <- 'lambda' LambdaParams? ':' Expr
LambdaParams <- LambdaParam (',' LambdaParam)* ','?
LambdaParam <- '**' Name | '*' Name? | '/' | Name ('=' Expr)?
Disjunction <- Negated (('or' | 'and') Negated | (BitOp | CompareOp) BitTerm)*
Negated <- /(?:not(?!\w)[ \t\f\r\n]*)*/ BitTerm
CompareOp <- /==|!=|<=|>=|<(?!<)|>(?!>)/ | /not(?!\w)[\s\\]+in(?!\w)/ | 'in' | /is(?!\w)[\s\\]+not(?!\w)/ | 'is'
BitOr <- BitTerm (BitOp BitTerm)*
BitOp <- /(?:<<|>>|\/\/|\*\*|[+\-*\/%@&|^])(?!=)/
BitTerm <- ('+' | '-' | '~') BitTerm | ('await' ?fn)? Atom Trailer*
Trailer <- Access | Call
Call <- '(' Args? ')'
Args <- Plain (',' Plain)* (',' Keyword)* ','? &')' | Keyword (',' Keyword)* ','?
Plain <- '*' Expr | NamedExpr CompFor? !'='
Keyword <- '**' Expr | Name '=' Expr | '*' Expr
Slices <- Slice (',' Slice)* ','?
Slice <- '*' BitOr | Expr? ':' Expr? (':' Expr?)? | NamedExpr
Atom <- String+ | Name | 'True' | 'False' | 'None' | Number | '...' | Paren | ListAtom | Braces
Paren <- '(' (Yield | NamedExpr CompFor | StarExprs)? ')'
ListAtom <- '[' (NamedExpr CompFor | StarExpr (',' StarExpr)* ','?)? ']'
Braces <- '{' ('**' BitOr | Expr ':' Expr) (CompFor | (',' ('**' BitOr | Expr ':' Expr))* ','?) '}' | '{' NamedExpr CompFor '}' | '{' (StarExpr (',' StarExpr)* ','?)? '}'
CompFor <- ('async'? 'for' StarTargets 'in' Disjunction ('if' (Lambda | Disjunction))*)+
"""
_PY_OPERATORS = ". ... , : := ; = == ( ) [ ] { } @ @= -> - -= + += * *= ** **= / /= // //= % %= & &= | |= ^ ^= ~ < << <<= > >> >>= <= >= !="


@lru_cache(maxsize=1)
def python_grammar() -> Grammar:
    return Grammar(PYTHON, trivia=r"[ \t\f\r\n]+|\\\r?\n|#[^\r\n\x01]*+", operators=_PY_OPERATORS, words=r"\w")


_PY_TOKEN = re.compile(
    r"""(?P<str>(?<!\w)[rRbBuUfFtT]{0,2}(?:\"\"\"|'''))|(?P<one>(?<!\w)[rRbBuUfFtT]{0,2}(?:"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*+'))"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<com>\#[^\r\n]*)|(?P<cont>\\(?:\r\n|\n|\r))|(?P<nl>\r\n|\n|\r)|(?P<sign>[\x01-\x03])"""
)
_PY_TEXT = {q: re.compile(rf"(?:[^\\{q[0]}]|\\[\s\S]|{q[0]}(?!{q[1:]}))*+{q}") for q in ('"""', "'''")}
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_REST = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|$)")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def python_lines(text: str) -> tuple[str | None, list[tuple[int, int]], int]:
    """(text with explicit lines and blocks, where its parts come from, first fault); no text if there is a fault.

    Only signs are put in between: what the grammar skips, comments and line ends within brackets among it, stays.
    """
    out: list[str] = []
    origin: list[tuple[int, int]] = []
    size, done, stack, indents = 0, 0, [], [0]
    at, fresh, n = 0, True, len(text)

    def put(sign: str, upto: int) -> None:
        """The text up to ``upto``, then ``sign``."""
        nonlocal size, done
        origin.append((size, done))
        out.append(text[done:upto])
        out.append(sign)
        size += upto - done + len(sign)
        done = upto

    while at <= n:
        if fresh and not stack:
            # the indentation of a logical line; blank and comment lines have none
            m = _PY_INDENT.match(text, at)
            body = m.end()
            if body >= n:
                break
            if text[body] in "\r\n#":
                at = _PY_REST.match(text, body).end()
                continue
            if text[body] == "\\" and text[body + 1 : body + 2] in ("\n", "\r"):
                # an empty line continued: its indentation is that of what follows
                at = _PY_REST.match(text, body).end()
                continue
            width = len(m.group().rpartition("\f")[2].expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                put("\x02", body)
            else:
                while width < indents[-1]:
                    indents.pop()
                    put("\x03", body)
                if width != indents[-1]:
                    return None, origin, body
            at, fresh = body, False
        m = _PY_TOKEN.search(text, at)
        if m is None:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "str":
            end = _PY_TEXT[m.group()[-3:]].match(text, at)
            if end is None:
                return None, origin, m.start()
            at = end.end()
        elif kind == "open":
            stack.append(m.group())
        elif kind == "close":
            if not stack or stack.pop() != _PAIRS[m.group()]:
                return None, origin, m.start()
        elif kind == "nl" and not stack:
            put("\x01", m.start())
            fresh = True
        elif kind == "sign":
            return None, origin, m.start()
    if stack:
        return None, origin, n
    put("\x01" if not fresh else "", n)
    for _ in indents[1:]:
        put("\x03", n)
    return "".join(out), origin, -1
