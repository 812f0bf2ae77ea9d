"""The standard taxonomy, in the form that ``taxonomy.match_taxonomy`` takes."""

from __future__ import annotations

# Fixed values: (category, name, pattern, weight, exact).
TERMS = [
    ("readiness", "portrait_of_graduate", r"portrait\s+of\s+(a\s+)?graduate", 1.0, True),
    ("readiness", "graduate_profile", r"graduate\s+profile", 1.0, True),
    ("readiness", "learner_profile", r"learner\s+profile", 0.9, False),
    ("readiness", "graduate_competencies", r"graduate\s+competenc(y|ies)", 0.9, False),
    ("readiness", "profile_of_graduate", r"profile\s+of\s+(a\s+)?graduate", 1.0, True),
    ("readiness", "student_success_vision", r"student\s+success\s+vision", 0.8, False),
    ("readiness", "future_ready_skills", r"future[- ]?ready\s+skills", 0.7, False),
    ("readiness", "habits_of_success", r"habits\s+of\s+success", 0.7, False),
    ("readiness", "community_compass", r"community\s+compass", 0.9, True),
    ("readiness", "stakeholder_engagement", r"stakeholder\s+engagement\s+framework", 0.85, False),
    ("readiness", "community_commitments", r"community\s+commitments?", 0.8, False),
    ("readiness", "community_visioning", r"community\s+visioning", 0.8, False),
    ("readiness", "listening_sessions", r"listening\s+sessions?", 0.6, False),
    ("readiness", "listening_tour", r"listening\s+tour", 0.6, False),
    ("readiness", "strategic_plan", r"strategic\s+plan(?:ning)?", 0.8, False),
    ("readiness", "strategic_priorities", r"strategic\s+priorit(y|ies)", 0.8, False),
    ("readiness", "district_vision_goals", r"district\s+vision\s+(&|and)\s+goals", 0.7, False),
    ("readiness", "strategic_framework", r"strategic\s+framework", 0.7, False),
    ("readiness", "strategic_roadmap", r"strategic\s+roadmap", 0.7, False),
    ("readiness", "mission_vision_refresh", r"mission[/\s]vision\s+refresh", 0.6, False),
    ("readiness", "implementation_roadmap", r"implementation\s+roadmap", 0.7, False),
    ("readiness", "portrait_roadmap", r"portrait\s+roadmap", 0.7, False),
    ("readiness", "action_roadmap", r"action\s+roadmap", 0.7, False),
    ("readiness", "operationalize_portrait", r"operationalize\s+portrait", 0.7, False),
    ("alignment", "portrait_of_educators", r"portrait\s+of\s+educators?", 0.9, True),
    ("alignment", "educator_competencies", r"educator\s+competenc(y|ies)", 0.9, False),
    ("alignment", "teacher_competencies", r"teacher\s+competenc(y|ies)", 0.9, False),
    ("alignment", "leadership_competencies", r"leadership\s+competenc(y|ies)", 0.85, False),
    ("alignment", "educator_profile", r"educator\s+profile", 0.85, False),
    ("alignment", "staff_competencies", r"staff\s+competenc(y|ies)", 0.8, False),
    ("alignment", "adult_competencies", r"adult\s+competenc(y|ies)", 0.8, False),
    ("alignment", "instructional_competencies", r"instructional\s+competenc(y|ies)", 0.8, False),
    ("alignment", "frameworks_for_learning", r"framework(s)?\s+for\s+learning", 0.85, True),
    ("alignment", "learning_framework", r"learning\s+framework", 0.85, False),
    ("alignment", "instructional_framework", r"instructional\s+framework", 0.85, False),
    ("alignment", "profile_aligned_curriculum", r"graduate\s+profile[- ]aligned\s+curriculum", 0.85, False),
    ("alignment", "learning_design_framework", r"learning\s+design\s+framework", 0.8, False),
    ("alignment", "curricular_alignment", r"curricular\s+alignment", 0.75, False),
    ("alignment", "competency_based_pathways", r"competency[- ]based\s+pathways?", 0.75, False),
    ("alignment", "learning_experience_accelerator", r"learning\s+experience\s+accelerator", 0.75, True),
    ("alignment", "teacher_capacity_building", r"teacher\s+capacity\s+building", 0.7, False),
    ("alignment", "deeper_learning_teachers", r"deeper\s+learning\s+for\s+teachers", 0.7, False),
    ("alignment", "collaborative_lesson_design", r"collaborative\s+lesson\s+design", 0.65, False),
    ("alignment", "personalized_pl_teachers", r"personalized\s+p[ld]\s+for\s+teachers", 0.65, False),
    ("alignment", "learning_labs", r"learning\s+labs?", 0.6, False),
    ("alignment", "design_studios", r"design\s+studios?", 0.6, False),
    ("activation", "measure_what_matters", r"measure\s+what\s+matters", 0.9, True),
    ("activation", "performance_tasks", r"performance\s+tasks?", 0.9, False),
    ("activation", "capstone", r"capstone", 0.9, False),
    ("activation", "cornerstone", r"cornerstone", 0.9, False),
    ("activation", "competency_rubrics", r"competency\s+rubrics?", 0.85, False),
    ("activation", "beyond_test_scores", r"beyond\s+test\s+scores", 0.8, False),
    ("activation", "authentic_assessment", r"authentic\s+assessment", 0.8, False),
    ("activation", "portfolio_assessment", r"portfolio\s+assessment", 0.8, False),
    ("activation", "graduate_outcomes_evidence", r"graduate\s+outcomes?\s+evidence", 0.8, False),
    ("activation", "profile_aligned_rubrics", r"profile[- ]aligned\s+rubrics?", 0.8, False),
    ("activation", "evidence_of_learning", r"evidence\s+of\s+learning", 0.75, False),
    ("activation", "application_of_learning", r"application\s+of\s+learning", 0.75, False),
    ("activation", "impact_showcase", r"impact\s+showcase", 0.8, True),
    ("activation", "student_showcase", r"student\s+showcase", 0.8, False),
    ("activation", "discovery_fairs", r"discovery\s+fairs?", 0.75, False),
    ("activation", "annual_celebrations", r"annual\s+celebrations?", 0.7, False),
    ("activation", "exhibition_of_learning", r"exhibition\s+of\s+learning", 0.8, False),
    ("activation", "portfolio_night", r"portfolio\s+night", 0.75, False),
    ("activation", "public_product", r"public\s+product", 0.75, False),
    ("activation", "community_celebration", r"community\s+celebration", 0.7, False),
    ("branding", "strategic_storytelling", r"strategic\s+storytelling", 0.6, True),
    ("branding", "brand_design", r"brand\s+design", 0.6, False),
    ("branding", "messaging_framework", r"messaging\s+framework", 0.6, False),
    ("branding", "portrait_launch_blueprint", r"portrait\s+launch\s+blueprint", 0.6, True),
    ("branding", "message_alignment", r"message\s+alignment", 0.55, False),
    ("branding", "communications_roadmap", r"communications?\s+roadmap", 0.55, False),
    ("branding", "narrative_framework", r"narrative\s+framework", 0.55, False),
    ("branding", "community_storytelling", r"community\s+storytelling", 0.5, False),
    ("branding", "campaign_plan", r"campaign\s+plan", 0.5, False),
]
