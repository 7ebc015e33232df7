"""Schemas of the relations, as DDL."""

PARAM = "struct<name:string,type:string,kind:string,default:string,pointer_depth:int,is_restrict:boolean,is_va_list:boolean>"
FUNCTION = (
    "struct<mangled:string,name:string,return_type:string,params:array<" + PARAM + ">,visibility:string,access:string,is_virtual:boolean,is_noexcept:boolean,is_extern_c:boolean,is_static:boolean,is_const:boolean,"
    "is_volatile:boolean,is_pure_virtual:boolean,is_deleted:boolean,is_inline:boolean,is_explicit:boolean,is_variadic:boolean,vtable_index:int,ref_qualifier:string,elf_visibility:string,exception_spec:string,deprecated:string,source_header:string,origin:string,is_hidden_friend:boolean,hidden_friend_owner:string>"
)
VARIABLE = "struct<mangled:string,name:string,type:string,visibility:string,is_const:boolean,value:string,access:string,alignment_bits:int,origin:string>"
FIELD = "struct<name:string,type:string,offset_bits:bigint,is_bitfield:boolean,bitfield_bits:int,is_const:boolean,is_volatile:boolean,is_mutable:boolean,access:string,default:string,deprecated:string>"
RECORD = (
    "struct<type_key:string,name:string,kind:string,size_bits:bigint,alignment_bits:int,is_union:boolean,is_opaque:boolean,is_final:boolean,is_standard_layout:boolean,is_trivially_copyable:boolean,is_abstract:boolean,"
    "data_size_bits:bigint,vptr_offset_bits:bigint,bases:array<string>,virtual_bases:array<string>,vtable:array<string>,base_offsets:map<string,bigint>,fields:array<" + FIELD + ">,source_header:string,origin:string>"
)
ENUM = "struct<type_key:string,name:string,underlying_type:string,is_scoped:boolean,members:array<struct<name:string,value:decimal(20,0)>>,source_header:string,origin:string>"
SYMBOL = "struct<name:string,binding:string,sym_type:string,visibility:string,size:bigint,version:string,is_default:boolean,origin_lib:string,value_alignment:int>"
ELF_HEADER = (
    "struct<soname:string,needed:array<string>,rpath:string,runpath:string,versions_defined:array<string>,versions_required:map<string,array<string>>,interpreter:string,relro:string,bind_now:boolean,is_pie:boolean,has_static_tls:boolean,has_textrel:boolean,executable_stack:boolean,machine:string,elf_class:int,pointer_size:int,ei_data:string,osabi:string,abi_flags:array<string>,e_flags:bigint,gnu_properties:array<string>,"
    "dynamic_flags:array<string>,has_init:boolean,has_fini:boolean,hash_styles:array<string>,has_dt_relr:boolean,has_stack_canary:boolean,has_fortify_source:boolean,has_writable_executable_segment:boolean,is_symbolic:boolean,min_kernel:string>"
)
KABI = "struct<crc:string,symbol:string,module:string,export_type:string,namespace:string>"

SNAPSHOT = (
    f"snapshot_id string, library string, version string, platform string, language_profile string, from_headers boolean, elf_only_mode boolean, schema_version int, functions array<{FUNCTION}>, variables array<{VARIABLE}>, "
    f"records array<{RECORD}>, enums array<{ENUM}>, typedefs map<string,string>, constants map<string,string>, elf {ELF_HEADER}, elf_symbols array<{SYMBOL}>, elf_imports array<{SYMBOL}>, kabi array<{KABI}>"
)
FACTS = "tu_id string, kind string, qualified_name string, header string, signature_hash string, body_hash string, type_hash string, value string"
REPORT = "target string, profile string, check_id string, truncated boolean, changes array<struct<kind:string,symbol:string,identity:string,description:string,old_value:string,new_value:string>>"
ELF = "path string, soname string, needed array<string>, rpath string, runpath string, symbols array<struct<name:string,binding:string,sym_type:string,visibility:string,size:bigint>>, imports array<struct<name:string,binding:string,sym_type:string,visibility:string,size:bigint>>"
FINDING = "pair_id string, kind string, symbol string, description string, old_value string, new_value string, detector string"
