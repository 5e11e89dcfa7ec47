"""Fixed values of the file format and of the analyses: opcodes, tags, kinds and name lists."""

from __future__ import annotations

# Opcode -> (mnemonic, operand format). special: switch tables and debug records.
OPCODES: dict[int, tuple[str, str]] = {
    0x01: ("bkpt", ""),
    0x02: ("nop", ""),
    0x03: ("throw", ""),
    0x04: ("getsuper", "u30"),
    0x05: ("setsuper", "u30"),
    0x06: ("dxns", "u30"),
    0x07: ("dxnslate", ""),
    0x08: ("kill", "u30"),
    0x09: ("label", ""),
    0x0C: ("ifnlt", "s24"),
    0x0D: ("ifnle", "s24"),
    0x0E: ("ifngt", "s24"),
    0x0F: ("ifnge", "s24"),
    0x10: ("jump", "s24"),
    0x11: ("iftrue", "s24"),
    0x12: ("iffalse", "s24"),
    0x13: ("ifeq", "s24"),
    0x14: ("ifne", "s24"),
    0x15: ("iflt", "s24"),
    0x16: ("ifle", "s24"),
    0x17: ("ifgt", "s24"),
    0x18: ("ifge", "s24"),
    0x19: ("ifstricteq", "s24"),
    0x1A: ("ifstrictne", "s24"),
    0x1B: ("lookupswitch", "special"),
    0x1C: ("pushwith", ""),
    0x1D: ("popscope", ""),
    0x1E: ("nextname", ""),
    0x1F: ("hasnext", ""),
    0x20: ("pushnull", ""),
    0x21: ("pushundefined", ""),
    0x23: ("nextvalue", ""),
    0x24: ("pushbyte", "u8"),
    0x25: ("pushshort", "u30"),
    0x26: ("pushtrue", ""),
    0x27: ("pushfalse", ""),
    0x28: ("pushnan", ""),
    0x29: ("pop", ""),
    0x2A: ("dup", ""),
    0x2B: ("swap", ""),
    0x2C: ("pushstring", "u30"),
    0x2D: ("pushint", "u30"),
    0x2E: ("pushuint", "u30"),
    0x2F: ("pushdouble", "u30"),
    0x30: ("pushscope", ""),
    0x31: ("pushnamespace", "u30"),
    0x32: ("hasnext2", "u30 u30"),
    0x35: ("li8", ""),
    0x36: ("li16", ""),
    0x37: ("li32", ""),
    0x38: ("lf32", ""),
    0x39: ("lf64", ""),
    0x3A: ("si8", ""),
    0x3B: ("si16", ""),
    0x3C: ("si32", ""),
    0x3D: ("sf32", ""),
    0x3E: ("sf64", ""),
    0x40: ("newfunction", "u30"),
    0x41: ("call", "u30"),
    0x42: ("construct", "u30"),
    0x43: ("callmethod", "u30 u30"),
    0x44: ("callstatic", "u30 u30"),
    0x45: ("callsuper", "u30 u30"),
    0x46: ("callproperty", "u30 u30"),
    0x47: ("returnvoid", ""),
    0x48: ("returnvalue", ""),
    0x49: ("constructsuper", "u30"),
    0x4A: ("constructprop", "u30 u30"),
    0x4C: ("callproplex", "u30 u30"),
    0x4E: ("callsupervoid", "u30 u30"),
    0x4F: ("callpropvoid", "u30 u30"),
    0x50: ("sxi1", ""),
    0x51: ("sxi8", ""),
    0x52: ("sxi16", ""),
    0x53: ("applytype", "u30"),
    0x55: ("newobject", "u30"),
    0x56: ("newarray", "u30"),
    0x57: ("newactivation", ""),
    0x58: ("newclass", "u30"),
    0x59: ("getdescendants", "u30"),
    0x5A: ("newcatch", "u30"),
    0x5D: ("findpropstrict", "u30"),
    0x5E: ("findproperty", "u30"),
    0x5F: ("finddef", "u30"),
    0x60: ("getlex", "u30"),
    0x61: ("setproperty", "u30"),
    0x62: ("getlocal", "u30"),
    0x63: ("setlocal", "u30"),
    0x64: ("getglobalscope", ""),
    0x65: ("getscopeobject", "u8"),
    0x66: ("getproperty", "u30"),
    0x68: ("initproperty", "u30"),
    0x6A: ("deleteproperty", "u30"),
    0x6C: ("getslot", "u30"),
    0x6D: ("setslot", "u30"),
    0x6E: ("getglobalslot", "u30"),
    0x6F: ("setglobalslot", "u30"),
    0x70: ("convert_s", ""),
    0x71: ("esc_xelem", ""),
    0x72: ("esc_xattr", ""),
    0x73: ("convert_i", ""),
    0x74: ("convert_u", ""),
    0x75: ("convert_d", ""),
    0x76: ("convert_b", ""),
    0x77: ("convert_o", ""),
    0x78: ("checkfilter", ""),
    0x80: ("coerce", "u30"),
    0x81: ("coerce_b", ""),
    0x82: ("coerce_a", ""),
    0x83: ("coerce_i", ""),
    0x84: ("coerce_d", ""),
    0x85: ("coerce_s", ""),
    0x86: ("astype", "u30"),
    0x87: ("astypelate", ""),
    0x88: ("coerce_u", ""),
    0x89: ("coerce_o", ""),
    0x90: ("negate", ""),
    0x91: ("increment", ""),
    0x92: ("inclocal", "u30"),
    0x93: ("decrement", ""),
    0x94: ("declocal", "u30"),
    0x95: ("typeof", ""),
    0x96: ("not", ""),
    0x97: ("bitnot", ""),
    0xA0: ("add", ""),
    0xA1: ("subtract", ""),
    0xA2: ("multiply", ""),
    0xA3: ("divide", ""),
    0xA4: ("modulo", ""),
    0xA5: ("lshift", ""),
    0xA6: ("rshift", ""),
    0xA7: ("urshift", ""),
    0xA8: ("bitand", ""),
    0xA9: ("bitor", ""),
    0xAA: ("bitxor", ""),
    0xAB: ("equals", ""),
    0xAC: ("strictequals", ""),
    0xAD: ("lessthan", ""),
    0xAE: ("lessequals", ""),
    0xAF: ("greaterthan", ""),
    0xB0: ("greaterequals", ""),
    0xB1: ("instanceof", ""),
    0xB2: ("istype", "u30"),
    0xB3: ("istypelate", ""),
    0xB4: ("in", ""),
    0xC0: ("increment_i", ""),
    0xC1: ("decrement_i", ""),
    0xC2: ("inclocal_i", "u30"),
    0xC3: ("declocal_i", "u30"),
    0xC4: ("negate_i", ""),
    0xC5: ("add_i", ""),
    0xC6: ("subtract_i", ""),
    0xC7: ("multiply_i", ""),
    0xD0: ("getlocal_0", ""),
    0xD1: ("getlocal_1", ""),
    0xD2: ("getlocal_2", ""),
    0xD3: ("getlocal_3", ""),
    0xD4: ("setlocal_0", ""),
    0xD5: ("setlocal_1", ""),
    0xD6: ("setlocal_2", ""),
    0xD7: ("setlocal_3", ""),
    0xEF: ("debug", "special"),
    0xF0: ("debugline", "u30"),
    0xF1: ("debugfile", "u30"),
}

# Container tag ids and their names.
TAGS: dict[int, str] = {
    0: "End",
    1: "ShowFrame",
    2: "DefineShape",
    6: "DefineBits",
    7: "DefineButton",
    8: "JPEGTables",
    9: "SetBackgroundColor",
    11: "DefineText",
    12: "DoAction",
    14: "DefineSound",
    20: "DefineBitsLossless",
    21: "DefineBitsJPEG2",
    26: "PlaceObject2",
    28: "RemoveObject2",
    32: "DefineShape3",
    33: "DefineText2",
    35: "DefineBitsJPEG3",
    36: "DefineBitsLossless2",
    37: "DefineEditText",
    39: "DefineSprite",
    43: "FrameLabel",
    46: "DefineMorphShape",
    48: "DefineFont2",
    56: "ExportAssets",
    57: "ImportAssets",
    59: "DoInitAction",
    60: "DefineVideoStream",
    65: "ScriptLimits",
    69: "FileAttributes",
    70: "PlaceObject3",
    72: "DoABC",
    75: "DefineFont3",
    76: "SymbolClass",
    77: "DefineBinaryData",
    82: "DoABC2",
    86: "DefineSceneAndFrameLabelData",
    255: "DebugID",
}

# Kinds of multinames, namespaces, traits, and the flags beside them.
QNAME, QNAME_A, RTQNAME, RTQNAME_A, RTQNAME_L, RTQNAME_LA = 0x07, 0x0D, 0x0F, 0x10, 0x11, 0x12
MULTINAME, MULTINAME_A, MULTINAME_L, MULTINAME_LA, TYPENAME = 0x09, 0x0E, 0x1B, 0x1C, 0x1D
NS_NAMESPACE, NS_PACKAGE, NS_INTERNAL, NS_PROTECTED, NS_EXPLICIT, NS_STATIC_PROTECTED, NS_PRIVATE = 0x08, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x05
SLOT, METHOD, GETTER, SETTER, CLASS, FUNCTION, CONST = range(7)
ATTR_FINAL, ATTR_OVERRIDE, ATTR_METADATA = 1, 2, 4
NEED_ARGUMENTS, NEED_ACTIVATION, NEED_REST, HAS_OPTIONAL, IGNORE_REST, NATIVE, SET_DXNS, HAS_PARAM_NAMES = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40, 0x80
SEALED, FINAL, INTERFACE, PROTECTED_NS = 0x01, 0x02, 0x04, 0x08

# Fixed values.
FRAMEWORK_TYPES = (
    "int", "uint", "Number", "String", "Boolean", "void", "Object", "Array", "Class", "Function", "*", "Namespace", "QName", "ByteArray",
    "Dictionary", "Date", "RegExp", "Error", "XML", "XMLList", "Sprite", "MovieClip", "DisplayObject", "DisplayObjectContainer", "BitmapData",
    "Bitmap", "Shape", "TextField", "TextFormat", "Event", "EventDispatcher", "MouseEvent", "KeyboardEvent", "TimerEvent", "IOErrorEvent",
    "SecurityErrorEvent", "ProgressEvent", "Point", "Rectangle", "Matrix", "ColorTransform", "Sound", "SoundChannel", "SoundTransform", "URLRequest",
    "URLLoader", "SharedObject", "Socket", "Timer", "Stage", "Loader", "LoaderInfo", "NetConnection", "Vector", "BlendMode",
)

# Fixed values.
CLASS_EDGE_KINDS = (
    "extends", "implements", "field_type", "param_type", "return_type", "call", "instantiation", "class_ref", "coerce",
)

# Fixed values.
BUILTIN_TYPES = (
    "int", "uint", "Number", "String", "Boolean", "void", "Object", "Array", "Class", "Function", "*", "ByteArray", "Dictionary", "Date", "RegExp",
    "Error", "XML", "Sprite", "MovieClip", "DisplayObject", "DisplayObjectContainer", "BitmapData", "Bitmap", "Shape", "TextField", "TextFormat",
    "Event", "MouseEvent", "KeyboardEvent", "TimerEvent", "Point", "Rectangle", "Matrix", "ColorTransform", "Sound", "SoundChannel", "SoundTransform",
    "URLRequest", "URLLoader", "SharedObject", "Timer", "Stage", "Vector.<int>", "Vector.<uint>", "Vector.<Number>", "Vector.<String>",
    "Vector.<Boolean>", "Vector.<Object>",
)

# Fixed values.
BRANCHES = (
    "jump", "iftrue", "iffalse", "ifeq", "ifne", "iflt", "ifle", "ifgt", "ifge", "ifstricteq", "ifstrictne", "ifnlt", "ifnle", "ifngt", "ifnge",
)

# Fixed values.
CALLS = (
    "callproperty", "callpropvoid", "callsuper", "callsupervoid", "callmethod", "callstatic", "callproplex", "call",
)

# Fixed values.
CONSTRUCTS = (
    "constructprop", "construct", "constructsuper",
)

# Fixed values.
ARITHMETIC = (
    "add", "subtract", "multiply", "divide", "modulo", "negate", "increment", "decrement", "increment_i", "decrement_i", "inclocal", "declocal",
    "inclocal_i", "declocal_i", "add_i", "subtract_i", "multiply_i", "negate_i", "add_d",
)

# Fixed values.
COMPARISONS = (
    "equals", "strictequals", "lessthan", "lessequals", "greaterthan", "greaterequals", "instanceof", "istype", "istypelate", "in", "typeof",
)

# Fixed values.
BITWISE = (
    "bitor", "bitand", "bitxor", "lshift", "rshift", "urshift", "bitnot",
)

# Fixed values.
COERCIONS = (
    "coerce", "coerce_a", "coerce_s", "coerce_b", "coerce_i", "coerce_d", "coerce_u", "coerce_o", "convert_s", "convert_i", "convert_d", "convert_b",
    "convert_u", "convert_o",
)

# Fixed values.
LIFECYCLE_NAMES = (
    "constructor", "<init>", "<cinit>", "onEnterFrame", "addedToStage", "removedFromStage", "frameConstructed", "onLoad", "onStart", "onComplete",
    "onError", "handleEvent", "dispatchEvent", "onExternalCall",
)

# Fixed values.
ENTRYPOINT_BASES = (
    "flash.display.Sprite", "flash.display.MovieClip", "flash.display.DisplayObject", "flash.display.Stage", "flash.events.EventDispatcher", "Sprite",
    "MovieClip", "DisplayObject", "Stage", "EventDispatcher",
)

OP = {name: code for code, (name, _) in OPCODES.items()}

# What an instruction contributes to each index.
STRING_OPS = ("pushstring", "debugfile")
REF_KINDS = {"constructprop": "instantiation", "callproperty": "call", "callpropvoid": "call", "getlex": "class_ref", "coerce": "coerce"}
ACCESS_TYPES = {"getproperty": "read", "setproperty": "write", "initproperty": "init"}
EDGE_TYPES = {
    "callproperty": "call", "callpropvoid": "call", "constructprop": "construct", "getproperty": "read", "getlex": "read",
    "findpropstrict": "read", "setproperty": "write", "initproperty": "write", "newclass": "class",
}
#: Opcodes whose first operand is resolved as a multiname.
MULTINAME_OPS = (
    "getsuper", "setsuper", "getdescendants", "findpropstrict", "findproperty", "getlex", "setproperty", "getproperty", "initproperty",
    "deleteproperty", "callsuper", "callproperty", "constructprop", "callproplex", "callsupervoid", "callpropvoid", "coerce", "astype", "istype",
)
ARG_OPS = ("callproperty", "callpropvoid", "callproplex", "constructprop")
