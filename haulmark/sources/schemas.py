"""Column types of the stored tables, as DDL strings for ``spark.read.schema``."""

INSUREDS = """insured_id string, company_name string, dba_name string, dot_number string, mc_number string,
    state_domicile string, city string, years_in_business int, fleet_size int, driver_count int, primary_operation string,
    primary_commodity string, safety_rating string, csa_unsafe_driving decimal(5,1), csa_hos decimal(5,1),
    csa_vehicle_maint decimal(5,1), csa_driver_fitness decimal(5,1), annual_revenue decimal(15,2), annual_mileage bigint,
    telematics_provider string, dashcam_coverage_pct decimal(5,2), risk_tier string, account_manager string, effective_date date"""

POLICIES = """policy_id string, insured_id string, line_of_business string, policy_status string, effective_date date,
    expiration_date date, written_premium decimal(12,2), liability_limit string, aggregate_limit string, deductible decimal(10,2),
    vehicles_covered int, territory string, broker_name string, underwriter string, renewal_status string,
    loss_ratio_current decimal(5,2)"""

DRIVERS = """driver_id string, insured_id string, first_name string, last_name string, cdl_number string, cdl_state string,
    cdl_class string, date_of_birth date, hire_date date, years_cdl_experience int, mvr_points int, mvr_date date,
    driver_status string, disqualifying_offense boolean, hazmat_endorsement boolean, tanker_endorsement boolean,
    accidents_3yr int, violations_3yr int, telematics_score decimal(5,1)"""

VEHICLES = """vehicle_id string, insured_id string, policy_id string, vin string, year int, make string, model string,
    vehicle_type string, gvw int, stated_value decimal(10,2), radius_class string, garage_state string, garage_zip string,
    has_dashcam boolean, has_eld boolean, last_inspection_date date, inspection_result string, annual_mileage int"""

CLAIMS = """claim_id string, policy_id string, insured_id string, loss_date date, report_date date, claim_status string,
    loss_type string, loss_description string, fault_percentage decimal(5,2), claimant_name string, adjuster string,
    attorney_involved boolean, litigation_status string, total_incurred decimal(12,2), total_paid decimal(12,2),
    case_reserves decimal(12,2), expense_paid decimal(12,2), subrogation_amount decimal(12,2), siu_referral boolean,
    large_loss_flag boolean, catastrophic_flag boolean, closure_date date"""

SUBMISSIONS = """submission_id string, insured_id string, company_name string, broker_name string, broker_contact string,
    submission_date date, target_effective date, submission_status string, fleet_size int, driver_count int,
    primary_operation string, primary_commodity string, requested_limits string, expiring_premium decimal(12,2),
    quoted_premium decimal(12,2), loss_ratio_3yr decimal(5,2), underwriter string, referral_required boolean,
    decline_reason string, days_to_quote int"""

LOSS_RUNS = """loss_run_id string, insured_id string, policy_id string, policy_period string, valuation_date date, num_claims int,
    total_incurred decimal(12,2), total_paid decimal(12,2), total_reserves decimal(12,2), earned_premium decimal(12,2),
    loss_ratio decimal(7,2), large_losses int, frequency decimal(5,2), severity decimal(12,2)"""

REFERRALS = """referral_id string, submission_id string, policy_id string, insured_id string, referral_date date,
    referral_reason string, referral_tier string, requesting_underwriter string, approving_authority string, decision string,
    conditions string, decision_date date, notes string"""

PARSED_DOCUMENTS = """doc_id string, source_path string, file_name string, category string, category_id string, parsed_text string,
    page_count int, file_size_bytes bigint, parsed_at timestamp, content_hash string"""

DOCUMENT_CHUNKS = """chunk_id string, parent_id string, chunk_type string, chunk_text string, doc_id string, category string,
    source_path string, char_start bigint, char_end bigint, created_at timestamp"""

CONVERSATIONS = "session_id string, role string, content string, user_id string, created_at timestamp"

FEEDBACK = """feedback_id string, session_id string, user_id string, question string, answer string, rating int, comment string,
    created_at timestamp, intent_classification string, promoted_to_eval boolean, promoted_at timestamp"""

OVERRIDES = """override_id string, session_id string, user_id string, submission_id string, ai_recommendation string,
    uw_decision string, override_reason string, override_detail string, created_at timestamp"""

EVAL_RESULTS = """run_id string, question_id string, question string, category string, intent string, role string,
    difficulty string, passed boolean, response_time_s double, response_length int, response_preview string,
    failed_checks string, run_timestamp string"""
