"""SQL fragments shared by several twins."""

# The field dictionary built from part, as the twin of operators.metadata.dictionary_from_parts.
DICT = """
with d as (select p_partkey row_id, replace(lower(p_name), ' ', '_') field_name, p_brand form_name, p_size size,
  case p_type when 'PROMO' then 'text' when 'SMALL' then 'text' when 'STANDARD' then 'radio' when 'MEDIUM' then 'checkbox'
    when 'LARGE' then 'dropdown' else 'calc' end field_type,
  case when p_partkey % 8 = 0 then '' else p_name end field_label,
  case when p_type in ('STANDARD', 'MEDIUM', 'LARGE') and p_size % 5 <> 0 then 2 else 0 end n_choices,
  case when p_type = 'PROMO' then 'integer' else '' end validation,
  case when p_size % 2 = 0 then 'y' else '' end required_field, case when p_partkey % 10 = 0 then 'y' else '' end identifier,
  case when p_size > 40 then '[x] = 1' else '' end branching_logic, case when p_partkey % 6 = 0 then 'm1' else '' end matrix_group_name,
  case when p_size % 7 = 0 then '@HIDDEN; @READONLY' else '' end tags, 'P' || (p_partkey % 3) project from part)
"""
