"""A small project of our own, as texts: what the extractor queries run on."""

from __future__ import annotations

PAGE = """<%@ taglib prefix="c" uri="http://x/core" %>
<%@ include file="/common/head.jsp" %>
<jsp:include page="side.jsp"/>
<% int n = 1; %><p>${order.total} #{cfg}</p><%= n %>
<form action="/save" method="post"><input name="a" required><select name="b"></select></form>
<a href="/order/list">all</a><a href="#x">x</a><img src="/logo.png">
<script>$.ajax({url: '/order/7', type: 'GET'}); fetch("/other", {method: "DELETE"});</script>"""
CONTROLLER = """package com.shop.web;
import com.shop.service.OrderService;
@Controller
@RequestMapping("/order")
public class OrderController {
    @Autowired
    private OrderService orderService; // the "service" {
    @GetMapping("/{id}")
    public String show(@PathVariable Long id, int size) { return "order/show" + orderService.find(id, f(1, 2)); }
    @RequestMapping(value = "/save", method = RequestMethod.POST)
    public String save() { orderService.store(null); return "done"; }
}"""
SERVICE = """package com.shop.service;
@Service
@Transactional(readOnly = true)
public class OrderService {
    private final OrderMapper orderMapper;
    public OrderService(OrderMapper orderMapper) { this.orderMapper = orderMapper; }
    public Order find(Long id, int k) throws NotFound, IOException { try { return this.orderMapper.byId(id); } catch (SqlError | Timeout e) { return null; } }
    @Transactional(rollbackFor = Exception.class)
    public void store(Order o) { orderMapper.insertOrder(o); }
}"""
INTERFACE = """package com.shop.dao;
@Mapper
public interface OrderMapper {
    Order byId(@Param("id") Long id);
    int insertOrder(Order o);
    void sync();
}"""
XML = """<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "-//x//DTD Mapper 3.0//EN" "http://x/m.dtd">
<mapper namespace="com.shop.dao.OrderMapper">
  <sql id="cols">id, total</sql>
  <resultMap id="r" type="Order"><id column="id" property="id"/><result column="total" property="total"/></resultMap>
  <select id="byId" resultMap="r">SELECT <include refid="cols"/> FROM shop.orders o LEFT JOIN users u ON u.id = o.uid <where><if test="id != null">id = #{id}</if></where></select>
  <insert id="insertOrder">INSERT INTO orders (id) VALUES (#{id,jdbcType=INTEGER})</insert>
  <select id="sync" statementType="CALLABLE">{CALL pkg.sync_user_data(#{id})}</select>
</mapper>"""
FILES = {
    "pom.xml": "<project/>", "src/main/webapp/WEB-INF/views/order.jsp": PAGE, "src/main/webapp/common/head.jsp": "<p>", "src/main/java/com/shop/web/OrderController.java": CONTROLLER,
    "src/main/java/com/shop/service/OrderService.java": SERVICE, "src/main/java/com/shop/dao/OrderMapper.java": INTERFACE, "src/main/resources/mapper/OrderMapper.xml": XML, "src/main/java/com/shop/UserEntity.java": "class UserEntity {}",
}
